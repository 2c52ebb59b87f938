"""Several workspaces by id: a bounded number is held open, the others are built again from their logs when they are asked for."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from .pipeline import Workspace, write_whole

CAPACITY = 8


class Sessions:
    """Workspaces whose logs are files of a folder. `load` makes the frame that a source, any JSON object, stands for."""

    def __init__(self, folder: str, load: Callable[[dict], DataFrame], capacity: int = CAPACITY):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.load, self.capacity = folder, load, capacity
        self._open: OrderedDict[str, Workspace] = OrderedDict()

    def _path(self, ws: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{32}", ws):
            raise KeyError(ws)
        return os.path.join(self.folder, f"{ws}.json")

    def _state(self, ws: str) -> dict:
        try:
            with open(self._path(ws), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            raise KeyError(ws) from None

    def _hold(self, ws: str, found: Workspace) -> Workspace:
        self._open[ws] = found
        self._open.move_to_end(ws)
        while len(self._open) > self.capacity:
            # only the plans go; the log stays
            self._open.popitem(last=False)
        return found

    def open(self, source: dict, time_column: str | None = None, name: str = "") -> str:
        ws = uuid.uuid4().hex
        found = Workspace.open(self.load(source), time_column)
        write_whole(self._path(ws), json.dumps({"name": name, "source": source, "updated": time.time(), "state": json.loads(found.save_log())}, ensure_ascii=False))
        self._hold(ws, found)
        return ws

    def get(self, ws: str) -> Workspace:
        """The workspace as it was saved last, or as it is in memory; KeyError if there is no such log."""
        if ws in self._open:
            return self._hold(ws, self._open[ws])
        state = self._state(ws)
        return self._hold(ws, Workspace.replay(self.load(state["source"]), json.dumps(state["state"])))

    def save(self, ws: str) -> None:
        state = self._state(ws)
        state |= {"updated": time.time(), "state": json.loads(self.get(ws).save_log())}
        write_whole(self._path(ws), json.dumps(state, ensure_ascii=False))

    def close(self, ws: str) -> bool:
        """Forgets a workspace and its log; whether there was one."""
        held = self._open.pop(ws, None) is not None
        try:
            os.remove(self._path(ws))
        except FileNotFoundError:
            return held
        return True

    def list(self) -> list[dict]:
        """All workspaces, those saved last first: id, name, source, version, commands, whether one is open."""
        known = [x.removesuffix(".json") for x in os.listdir(self.folder) if re.fullmatch(r"[0-9a-f]{32}\.json", x)]
        states = sorted(((ws, self._state(ws)) for ws in known), key=lambda x: -x[1]["updated"])
        return [{"id": ws, "name": s["name"], "source": s["source"], "version": s["state"]["cursor"], "commands": len(s["state"]["log"]), "open": ws in self._open} for ws, s in states]

    def probe(self, ws: str, version: int | None = None) -> dict:
        """Whether a workspace can be had, building it again if need be; its version, rows and what can be undone, or why not. drift: the caller knows another version."""
        try:
            found = self.get(ws)
            rows = found.df.count()
        except KeyError:
            return {"alive": False, "reason": "there is no log"}
        except (ValueError, OSError) as e:
            return {"alive": False, "reason": str(e)}
        return {"alive": True, "version": found.cursor, "rows": rows, "canUndo": found.cursor > 0, "canRedo": found.cursor < len(found.log), "drift": version not in (None, found.cursor)}
