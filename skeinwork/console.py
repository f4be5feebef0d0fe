"""Questions and commands from a terminal, or from any pair of callables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from .engine import Engine
from .sources import files

HELP = """/files list | add PATHS | remove PATH | watch FOLDER CHECKPOINT | stop   (paths between commas)
/mode standard | graph      /alpha NUMBER      /set NAME VALUE      /settings      /stats      /status      /quit"""


class Console:
    """A session over one engine; ``handle`` takes one line and gives what to show, or None when the session ends.

    Whatever a line brings up is shown and leaves the session going. The history has answered questions only.
    """

    def __init__(self, engine: Engine, graph: bool = False, ask: Callable[[str], str] = input, say: Callable[[str], None] = print):
        self.engine, self.ask, self.say = engine, ask, say
        self.graph, self.history, self.watching = graph, [], None
        self.commands = {"/files": self.files, "/mode": self.mode, "/alpha": lambda x: self.set(f"alpha {x}"), "/set": self.set, "/settings": self.settings,
                         "/stats": lambda _: str(self.engine.stats()), "/status": lambda _: str(self.engine.status()), "/help": lambda _: HELP}

    def run(self) -> None:
        try:
            while True:
                try:
                    line = self.ask("> ")
                except (EOFError, KeyboardInterrupt):
                    return
                shown = self.handle(line)
                if shown is None:
                    return
                if shown:
                    self.say(shown)
        finally:
            self.stop()

    def handle(self, line: str) -> str | None:
        line = line.strip()
        name, _, rest = line.partition(" ")
        if name in ("/quit", "/exit"):
            return None
        try:
            if name.startswith("/"):
                return self.commands[name](rest.strip()) if name in self.commands else HELP
            return self.question(line) if line else ""
        except Exception as e:  # noqa: BLE001  a session outlives a failed line
            return f"{type(e).__name__}: {e}"

    def question(self, text: str) -> str:
        parts, sources = self.engine.answer(text, self.history, self.graph)
        said = "".join(parts)
        self.history = [*self.history, (text, said)][-self.engine.config.history_turns :]
        return f"{said}\n{sources}".rstrip()

    def mode(self, name: str) -> str:
        """Graph mode builds the graph first, and stays off where that fails."""
        if name not in ("standard", "graph"):
            return HELP
        if name == "graph":
            self.engine.build_graph()
        self.graph = name == "graph"
        return f"mode {name}"

    def set(self, text: str) -> str:
        """One setting, validated with all others; what the index is made of can't change under it."""
        name, _, value = text.partition(" ")
        kinds = {f.name: type(f.default) for f in dataclasses.fields(self.engine.config) if type(f.default) in (int, float)}
        if name not in kinds or name == "embedding_dimension":
            return f"no such setting: {name}"
        self.engine.config = dataclasses.replace(self.engine.config, **{name: kinds[name](value)})
        return f"{name} = {getattr(self.engine.config, name)}"

    def settings(self, _: str = "") -> str:
        return "\n".join(f"{k} = {v}" for k, v in dataclasses.asdict(self.engine.config).items())

    def files(self, text: str) -> str:
        what, _, rest = text.partition(" ")
        if what == "list":
            return "\n".join(r[0] for r in self.engine.store.table("sources").select("source_path").orderBy("source_path").toLocalIterator())
        if what == "add" and rest:
            return f"version {self.engine.add(files.parse_paths(rest))}"
        if what == "remove" and rest:
            return f"{self.engine.remove(path=rest.strip())} chunks removed"
        if what == "watch" and len(rest.split()) == 2:
            self.stop()
            self.watching = self.engine.watch(*rest.split())
            return f"watching {rest.split()[0]}"
        return self.stop() if what == "stop" else HELP

    def stop(self) -> str:
        if self.watching is None:
            return "not watching"
        self.watching.stop()
        self.watching = None
        return "stopped"
