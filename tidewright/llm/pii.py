"""PII surrogates, native.

Entities are found by one pattern per type and get replacements that are keyed (a SHA-256 of key, type and entity), of the same
type (digits for digits, the check digits of cards and IBANs right or wrong as they were, addresses in range, names of the same gender and
script) and of each mention's own format (separators, brackets, letter case). A mention is reduced to its entity first: digits of a number,
lower case of an address or name; so all mentions of an entity, in whatever format, share a surrogate.
A person is found after a title, and then wherever the same text has the same name again without one. A name is two entities, the last name
and the first name of that last name: so "Frau Müller" and "Frau Anna Müller" share the last name's surrogate. The gender of a first name is that
of all titles that it has with that last name in the corpus; unknown if they disagree.
Distinctness: all entities of the corpus, one row each, are checked for equal surrogates and for surrogates that are entities of
the corpus themselves; but for one of each, those draw again with the next attempt number, until there are none. Each
attempt lengthens names, addresses and numbers by a part of its own, so the space grows with the entities.

Defined cases: a null text stays null; texts without entities stay as they are, to the byte; repeated rows get equal texts; a null id is
an id like others; an entity that a third of the documents mention is one row, and joins on entities may split its mentions; an empty table gives an empty
result; further columns pass through, and those added here replace others of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# What is detected, in order of precedence
TITLES_F, TITLES_M, TITLES_N = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа|г-жа", "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н", "Dr|Prof"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])\d{4}(?:[ -]?\d{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![0-9])|(?<![0-9A-Za-z])\+\d{8,15}(?![0-9])",
    "person": rf"(?:(?<=\b(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? ))\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
TYPES = tuple(PATTERNS)
PERSON = TYPES.index("person")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text in which this is not found holds no entity; the search is much cheaper.
HINT = rf"[0-9@]|\b(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\b"
# Names by script and gender; the last pairs with any gender
NAMES = {
    "latin_f": "Anna Clara Diane Elena Emma Greta Hanna Ines Julia Karin Laura Lucia Maria Nadia Nora Paula Petra Rosa Sarah Sonia Teresa Ursula Vera Zoe",
    "latin_m": "Adam Albert Bruno Carlos David Emil Felix Georg Hugo Ivan Jakob Karl Leon Lukas Martin Nico Oscar Paul Peter Rafael Simon Thomas Victor Walter",
    "latin_n": "Alex Andrea Ariel Charlie Chris Dominique Eden Jamie Jordan Jules Kai Kim Lee Lou Marlow Max Morgan Noa Quinn Robin Sascha Sidney Toni Val",
    "cyrillic_f": "Алина Анна Вера Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Софья Тамара Юлия",
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Тимур Юрий",
    "cyrillic_n": "Женя Саша Валя Слава",
}
# Parts of which last names are built, by script: one beginning, one middle more each attempt, one ending that fits any gender
LAST = {
    "latin": ("Al Ar Ba Be Bo Bra Ca Cor Da De Do Fa Fer Ga Gre Ha Hol Ja Ke Kro La Lo Ma Mer Mo Na Nor Pa Per Ra Ro Sa Sol Ta Tor Va Ver Wa Wil Zan", "ba be bi da de di do ga ge la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vi", "bert der din feld ger hardt kins land ler lin man mer mont nard ner rell ren rick sen ser son stein ton ville vin well"),
    "cyrillic": ("Ба Бе Бо Ва Ве Га Го Да До За Ка Ко Кра Ла Ли Ло Ма Ми Мо На Но Па Пе Ра Ро Са Се Си Та То Фе Ха Ша", "ба бе ва ве га да де за ка ла ле ли ло ма ме ми на не ни но ра ре ри ро са се та те ти то", "бенко вченко женко ленко менко ненко ренко сенко тенко чук щук ных ских тых дзе швили"),
}
#: Attempts after which addresses and numbers get longer.
ATTEMPTS = 8
#: What is an entity: the types, and names in two parts.
LAST_NAME, FIRST_NAME = len(PATTERNS), len(PATTERNS) + 1


def _kind(mention: Column) -> Column:
    """Number of the type: of those whose pattern takes the whole mention the first; names, which need what stands before them, are what is left."""
    out = F.lit(TYPES.index("person"))
    for i, pattern in reversed(list(enumerate(list(PATTERNS.values())[:-1]))):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), i).otherwise(out)
    return out


def _entity(kind: Column, mention: Column) -> Column:
    digits = kind.isin(*[TYPES.index(t) for t in ("card", "ssn", "phone")])
    return F.when(digits, F.regexp_replace(mention, "[^0-9]", "")).when(kind == TYPES.index("iban"), F.regexp_replace(mention, " ", "")).otherwise(F.lower(mention))


def _found(df: DataFrame, t: Column, pattern: Column) -> DataFrame:
    """df with __gaps, what stands between matches of the pattern, and __mentions (kind, entity, gender, mention)."""
    found = _extracted(t, pattern)
    by_title = lambda gap: F.when(gap.rlike(rf"\b(?:{TITLES_F})\.? $"), "f").when(gap.rlike(rf"\b(?:{TITLES_M})\.? $"), "m").otherwise("n")
    df = df.withColumn("__gaps", F.when(F.col("__any"), F.split(t, pattern, -1)))
    pairs = F.filter(F.zip_with("__gaps", F.when(F.col("__any"), found), lambda g, m: F.struct(by_title(g).alias("gender"), m.alias("mention"), F.when(m.isNotNull(), _kind(m)).alias("kind"))), lambda x: x["mention"].isNotNull())
    person = lambda x: x["kind"] == PERSON
    return df.withColumn("__mentions", F.transform(pairs, lambda x: F.struct(x["kind"].alias("kind"), _entity(x["kind"], x["mention"]).alias("entity"), F.when(person(x), x["gender"]).otherwise("").alias("gender"), x["mention"].alias("mention"))))


def _extracted(t: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(t, pattern, F.lit(0))


def mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __gaps, what stands between mentions, and __mentions (kind, entity, gender, mention); both null if there are none."""
    t = F.col(text)
    df = df.withColumn("__any", F.coalesce(t.rlike(HINT) & t.rlike(ANY), F.lit(False)))
    # names that stand after a title are searched for in the whole text, the longest first
    titled = F.array_distinct(_extracted(t, F.lit(PATTERNS["person"])))
    longest = F.array_sort(titled, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    again = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}'-])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}'-])"))
    df = df.withColumn("__pattern", F.when(F.col("__any") & t.rlike(rf"\b(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\b") & t.rlike(PATTERNS["person"]), again))
    return _found(df, t, F.coalesce("__pattern", F.lit(ANY))).drop("__any", "__pattern")


def _digest(key: str, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.col("kind").cast("string"), F.col("gender"), attempt.cast("string"), F.col("entity")), 512)


def _number(digest: Column, at: Column | int, width: int = 6) -> Column:
    """So many hex digits of the digest as a number; at counts from 0 and wraps."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, at * width % (128 - width) + 1, width), 16, 10).cast("long")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    doubled = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.when((n - i) % 2 == 0, F.lit(2) * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _mod97(iban: Column) -> Column:
    """What an IBAN leaves modulo 97, its first four characters put last and letters counted from 10; 1 if it is right."""
    moved = F.filter(F.split(F.regexp_replace(iban, "^(.{4})(.*)$", "$2$1"), ""), lambda c: c != "")
    add = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), add)


def _pick(digest: Column, names: str, at: Column | int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names.split()]), (_number(digest, at) % len(names.split()) + 1).cast("int"))


def _picks(digest: Column, names: str, first: int, last: Column, between: str) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(first), last), lambda i: _pick(digest, names, i)), between)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, entity, gender, attempt) with surrogate, a draw for that attempt."""
    df = entities.withColumn("d", _digest(key, F.col("attempt")))
    d, e, attempt = F.col("d"), F.col("entity"), F.col("attempt")
    chars = F.filter(F.split(e, ""), lambda c: c != "")
    # letters become letters and digits digits, each by its own part of the digest; the first digit of a card or phone number and a country stay
    def fill(keep: int) -> Column:
        drawn = lambda c, i: F.when(i < keep, c).when(c.rlike("[0-9]"), (_number(d, i, 2) % 10).cast("string")).when(c.rlike("[A-Z]"), F.char(65 + _number(d, i, 2) % 26)).when(c.rlike("[a-z]"), F.char(97 + _number(d, i, 2) % 26)).otherwise(c)
        return F.array_join(F.transform(chars, drawn), "")

    df = df.withColumns({"filled": fill(0), "kept": fill(1), "country": fill(2)})
    body = F.expr("substring(kept, 1, length(kept) - 1)")
    # the last digit is chosen so that the check is right, or wrong by as much as it was
    check = F.pmod(_luhn(e) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    open_ = F.concat(F.substring(e, 1, 2), F.lit("00"), F.expr("substring(country, 5, length(country))"))
    digits = F.pmod(_mod97(e) - _mod97(open_), F.lit(97))
    iban = F.concat(F.substring(e, 1, 2), F.lpad(F.when(digits < 2, digits + 97).otherwise(digits).cast("string"), 2, "0"), F.expr("substring(country, 5, length(country))"))
    octets = F.concat_ws(".", *[(1 + _number(d, i) % 254).cast("string") for i in range(4)])
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    mail = F.concat(F.substring("filled", F.lit(1), F.length(local)), F.lit("@"), F.lit("mail"), (_number(d, 20) % 10_000).cast("string"), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (_number(d, 19) % 3 + 1).cast("int")))
    cyrillic = F.col("entity").rlike(r"\p{IsCyrillic}")
    # after the first attempt a second first name is joined, then a third, and so on
    first = F.lit(None)
    for name, pool in NAMES.items():
        script, gender = name.split("_")
        joined = _picks(d, pool, 0, attempt, "-")
        first = F.when((F.col("gender") == gender) & (cyrillic if script == "cyrillic" else ~cyrillic), joined).otherwise(first)
    built = {script: F.concat(_pick(d, begin, 0), _picks(d, middle, 1, attempt + 1, ""), _pick(d, end, 20)) for script, (begin, middle, end) in LAST.items()}
    last = F.when(cyrillic, built["cyrillic"]).otherwise(built["latin"])
    drawn = {"email": mail, "ip": octets, "iban": iban, "card": F.concat(body, check), "ssn": F.col("filled"), "phone": F.col("kept")}
    # where the space of a format may be full, later attempts lengthen what is drawn
    tail = F.substring(F.translate(F.substring(d, 90, 12), "abcdef", "012345"), F.lit(1), attempt - ATTEMPTS + 1)
    longer = {"email": F.concat(F.translate(tail, "0123456789", "ghijklmnop"), mail)}
    out = F.when(F.col("kind") == LAST_NAME, F.lower(last)).when(F.col("kind") == FIRST_NAME, F.lower(first))
    # a name that comes whole
    out = out.when(F.col("kind") == PERSON, F.lower(F.concat_ws(" ", F.when(e.contains(" "), first), last)))
    for i, kind in enumerate(TYPES):
        if kind != "person":
            out = out.when(F.col("kind") == i, F.when(attempt >= ATTEMPTS, longer.get(kind, F.concat(drawn[kind], tail))).otherwise(drawn[kind]))
    return df.withColumn("surrogate", out).select(*entities.columns, "surrogate")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, entity, gender), one row each, with surrogates of which no two are equal and none is an entity.

    First names are entities of the form last name, line feed, first name; their surrogates differ among those of one last name.
    """
    of = F.when(F.col("kind") == FIRST_NAME, F.substring_index("entity", "\n", 1)).otherwise("")
    entities = written(entities.withColumn("of", of), "entities")
    given = written(surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    taken = entities.select("kind", "of", F.substring_index("entity", "\n", -1).alias("surrogate")).distinct().withColumn("real", F.lit(True))
    while True:
        # what has a surrogate of its own needs no window: equal ones are counted first
        equal = given.groupBy("kind", "of", "surrogate").agg(F.min(F.struct("attempt", "entity", "gender")).alias("first"))
        marked = given.join(taken, ["kind", "of", "surrogate"], "left").join(equal, ["kind", "of", "surrogate"])
        clash = F.col("real").isNotNull() | (F.struct("attempt", "entity", "gender") != F.col("first"))
        marked = written(marked.withColumn("clash", clash).drop("real", "first"), "surrogates")
        if marked.where("clash").isEmpty():
            return given.drop("of")
        again = marked.where("clash").select("kind", "entity", "gender", "of", (F.col("attempt") + 1).alias("attempt"))
        given = marked.where("not clash").select(*given.columns).union(surrogates(again, key).select(*given.columns))
        given = written(given, "surrogates")


def _worded(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: its separators for numbers, its letter case for the rest."""
    numbers = kind.isin(*[TYPES.index(t) for t in ("card", "ssn", "phone", "iban")])
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    put = lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(a["s"], F.substring(surrogate, a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    filled = F.aggregate(F.filter(F.split(mention, ""), lambda c: c != ""), start, put)
    filled = F.concat(filled["s"], F.substring(surrogate, filled["k"] + 1, F.length(surrogate)))
    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate)).when(kind == TYPES.index("person"), F.array_join(F.transform(F.split(surrogate, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.initcap(p)), "-")), " ")).otherwise(surrogate)
    return F.when(numbers, filled).otherwise(cased)


def replace(df: DataFrame, *, key: str = "surrogates-1", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the surrogates in its texts and n_entities. The rows are shuffled once, to meet their surrogates; everything before is done on mentions."""
    found = mentions(df, text).withColumn("__sum", F.xxhash64(text))
    # of each distinct pair of id and text, the mentions
    listed = written(found.where("__mentions is not null").select(F.col(doc_id).alias("__id"), "__sum", F.posexplode("__mentions").alias("at", "m")).select("__id", "__sum", "at", "m.*").distinct(), "mentions")
    person, words = F.col("kind") == PERSON, F.split("entity", " ")
    last, first = F.element_at(words, -1), F.when(F.size(words) > 1, F.concat_ws("\n", F.element_at(words, -1), F.element_at(words, 1)))
    names = listed.where(person).select("gender", last.alias("last"), first.alias("first"))
    all_of = listed.where(~person).select("kind", "entity", F.lit("").alias("gender")).union(names.select(F.lit(LAST_NAME), "last", F.lit("")))
    genders = names.where("first is not null").groupBy(F.col("first").alias("entity")).agg(F.array_sort(F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))).alias("g"))
    genders = genders.select(F.lit(FIRST_NAME).alias("kind"), "entity", F.when(F.size("g") == 1, F.get("g", 0)).otherwise("n").alias("gender"))
    known = distinct_surrogates(all_of.distinct().union(genders), key)
    known = known.select(F.col("kind").alias("__kind"), F.col("entity").alias("__entity"), "surrogate")
    # a mention needs the surrogate of its entity, or of its last name and, if it has one, of its first name
    parts = listed.withColumns({"__first": F.when(person, first), "__main": F.when(person, last).otherwise(F.col("entity")), "__of": F.when(person, LAST_NAME).otherwise(F.col("kind"))})
    named = parts.join(known, (F.col("__of") == F.col("__kind")) & (F.col("__main") == F.col("__entity"))).drop("__kind", "__entity")
    firsts = known.where(F.col("__kind") == FIRST_NAME).select(F.col("__entity").alias("__e"), F.col("surrogate").alias("__s"))
    named = named.join(firsts, F.col("__first") == F.col("__e"), "left").withColumn("surrogate", F.concat_ws(" ", "__s", "surrogate"))
    named = named.select("__id", "__sum", "at", _worded(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("put"))
    by_text = named.groupBy("__id", "__sum").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "put"))), lambda x: x["put"]).alias("__put"))
    by_text = by_text.withColumnRenamed("__sum", "__of")
    out = found.join(by_text, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__sum") == F.col("__of")), "left")
    done = F.array_join(F.zip_with("__gaps", "__put", lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    out = out.withColumns({text: F.when(F.col("__put").isNotNull(), done).otherwise(F.col(text)), "n_entities": F.coalesce(F.size("__put"), F.lit(0)).cast("int")})
    return out.drop("__gaps", "__mentions", "__sum", "__id", "__of", "__put")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
