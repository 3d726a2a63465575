"""Folds over one key's rows in order: phases, bursts, moments and trends. Plain state machines, the same as their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from .replay import Memory

SECOND = 1_000_000


def activity_class(reads: int, writes: int, fixes: int, security: int) -> str:
    total = reads + writes + fixes + security
    for n, name in ((fixes, "Debugging"), (security, "Hardening"), (writes, "Coding"), (reads, "Exploring")):
        if n and n * 100 // total >= 40:
            return name
    return "Mixed"


def counter_of(row: dict) -> int | None:
    """Which of the four activity counters an event adds to."""
    kind, tool = row.get("kind"), row.get("tool")
    if kind in ("search_query", "symbol_resolved"):
        return 0
    if kind == "tool_call":
        return 3 if tool in ("scan", "architect", "janitor") else None
    return {"file_change": 1, "diagnostic": 2}.get(kind)


class Phases:
    """Journey phases: a phase ends when the module changes or after more than idle_s without an event, and is emitted then:
    phase, module, events, duration_s, start, files, activity. forget_s after its last event a session is forgotten, and would
    begin anew; None keeps its number and module for ever."""

    def __init__(self, idle_s: int = 300, max_files: int = 10, forget_s: int | None = 30 * 86400) -> None:
        self.idle_s, self.max_files, self.forget_s = idle_s, max_files, forget_s

    @staticmethod
    def emitted(m: Memory) -> tuple:
        return m["phase"], m["module"], m["events"], m["last"] - m["start"], m["start"], len(m["files"]), activity_class(*m["counts"])

    def step(self, m: Memory | None, at: int, row: dict) -> tuple[Memory, list[tuple]]:
        epoch, module, out = at // SECOND, row.get("module") or None, []
        if m is None:
            m = {"phase": 0, "module": None, "open": False, "last": epoch}
            new = False
        else:
            new = (m["module"] is not None and module is not None and module != m["module"]) or epoch - m["last"] > self.idle_s
        if new and m["open"]:
            out.append(self.emitted(m))
        if new:
            m["phase"] += 1
        if new or not m["open"]:
            m |= {"open": True, "start": epoch, "events": 0, "files": [], "counts": [0, 0, 0, 0]}
        m["module"] = module or m["module"]
        m["events"] += 1
        m["last"] = epoch
        if (k := counter_of(row)) is not None:
            m["counts"][k] += 1
        subject = row.get("subject")
        if row.get("kind") == "file_change" and subject is not None and subject not in m["files"] and len(m["files"]) < self.max_files:
            m["files"].append(subject)
        return m, out

    def until(self, m: Memory, watermark: int) -> tuple[Memory | None, list[tuple], int | None]:
        out, idle = [], (m["last"] + self.idle_s + 1) * SECOND
        if m["open"] and watermark >= idle - 1:
            out.append(self.emitted(m))
            m = {k: m[k] for k in ("phase", "module", "last")} | {"open": False}
        if m["open"]:
            return m, out, idle
        if self.forget_s is None:
            return m, out, None
        forget = (m["last"] + max(self.forget_s, self.idle_s)) * SECOND
        return (None, out, None) if watermark >= forget else (m, out, forget)


class Bursts:
    """Runs (start, n) of triggers: the first trigger opens a window of gap_s, or of long_gap_s if `many` triggers, itself included,
    fell in the long_gap_s before it; triggers before the fixed deadline merge. A run is emitted once, when its deadline has
    passed; long_gap_s after the last trigger nothing is kept."""

    def __init__(self, gap_s: float = 2, long_gap_s: float = 5, many: int = 3) -> None:
        self.gap, self.long, self.many = int(gap_s * SECOND), int(long_gap_s * SECOND), many

    @staticmethod
    def emitted(m: Memory) -> tuple:
        return m["start"] / SECOND, m["n"]

    def step(self, m: Memory | None, at: int, row: dict) -> tuple[Memory, list[tuple]]:
        m = m or {"start": None, "deadline": None, "n": 0, "recent": []}
        recent, out = [t for t in m["recent"] if t > at - self.long], []
        m["recent"] = [*recent, at]
        if m["n"] and at < m["deadline"]:
            m["n"] += 1
            return m, out
        if m["n"]:
            out.append(self.emitted(m))
        m |= {"start": at, "n": 1, "deadline": at + (self.long if len(m["recent"]) >= self.many else self.gap)}
        return m, out

    def until(self, m: Memory, watermark: int) -> tuple[Memory | None, list[tuple], int | None]:
        out = []
        if m["n"] and watermark >= m["deadline"]:
            out.append(self.emitted(m))
            m["n"] = 0
        if m["n"]:
            return m, out, m["deadline"]
        recent = m["recent"][-1] + self.long
        return (None, out, None) if watermark >= recent else (m, out, recent)


class Moments:
    """After each event what the rules of a moment need, over a ring of the newest `window` events: event_id, n, avg_interval, modules,
    subjects, variance, repeats, read_ratio, errors, trend, phases, looping, activity."""

    def __init__(self, window: int = 15, repeat_s: int = 120, idle_s: int = 300, loop_window: int = 6, forget_s: int | None = 30 * 86400) -> None:
        self.window, self.repeat_s, self.loop_window, self.forget_s = window, repeat_s, loop_window, forget_s
        self.phases = Phases(idle_s, forget_s=None)

    def step(self, m: Memory | None, at: int, row: dict) -> tuple[Memory, list[tuple]]:
        m = m or {"ring": [], "phase": None, "trail": [], "errors": []}
        m["phase"], _ = self.phases.step(m["phase"], at, row)
        phase = m["phase"]
        if not m["trail"] or m["trail"][-1][0] != phase["phase"]:
            m["trail"] = [*m["trail"], [phase["phase"], None]][-self.loop_window :]
        m["trail"][-1][1] = phase["module"]
        if row.get("errors") is not None:
            m["errors"] = [*m["errors"], row["errors"]][-2:]
        m["ring"] = [*m["ring"], [at // SECOND, row.get("kind"), row.get("module") or None, row.get("subject")]][-self.window :]
        ring, n = m["ring"], len(m["ring"])
        now, subject = ring[-1][0], ring[-1][3]
        reads, writes = (sum(r[1] in kinds for r in ring) for kinds in (("search_query", "symbol_resolved"), ("file_change",)))
        subjects = len({r[3] for r in ring if r[3] is not None})
        trail = [name for _, name in m["trail"]][::-1]
        errors = m["errors"]
        out = (row.get("event_id"), n, (now - ring[0][0]) / (n - 1) if n > 1 else 999.0, len({r[2] for r in ring if r[2] is not None}), subjects, subjects / n,
               sum(subject is not None and r[3] == subject and now - r[0] <= self.repeat_s for r in ring), reads / (reads + writes) if reads + writes else 0.5,
               errors[-1] if errors else 0, (errors[-1] > errors[0]) - (errors[-1] < errors[0]) if errors else 0, phase["phase"] + 1, self.looping(trail),
               activity_class(*phase["counts"]))
        m["last"] = now
        return m, [out]

    def looping(self, trail: list[str | None]) -> bool:
        """trail is newest first; with a module that is not known yet there is no loop."""
        if len(trail) < self.loop_window or None in trail:
            return False
        a, b = trail[0], trail[1]
        swings = a != b and all(name == (a if i % 2 == 0 else b) for i, name in enumerate(trail))
        return swings or trail.count(a) >= 3

    def until(self, m: Memory, watermark: int) -> tuple[Memory | None, list[tuple], int | None]:
        if self.forget_s is None:
            return m, [], None
        forget = (m["last"] + self.forget_s) * SECOND
        return (None, [], None) if watermark >= forget else (m, [], forget)


class Previous:
    """Every row with what the row before it had: emit(row, row before or None)."""

    def __init__(self, emit: Callable[[dict, dict | None], tuple]) -> None:
        self.emit = emit

    def step(self, m: Memory | None, at: int, row: dict) -> tuple[Memory, list[tuple]]:
        return {"row": row}, [self.emit(row, m and m["row"])]

    def until(self, m: Memory, watermark: int) -> tuple[Memory | None, list[tuple], int | None]:
        return m, [], None
