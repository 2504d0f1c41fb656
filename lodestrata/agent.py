"""Client of the engine for an agent: recall before a turn, its turns and delegations kept as session records."""

from __future__ import annotations

import fcntl
import json
import os
import re
import time
import uuid
from collections.abc import Callable

from lodestrata.api import Engine

#: Hits that a recall may show, and those it shows unless told otherwise (fixed values).
MOST_HITS, HITS = 8, 6


class AgentMemory:
    """Evidence for an agent's questions, and a record of what it said.

    ``is_threat`` tells excerpts that mustn't reach the agent (instructions
    smuggled into evidence); records are only written by a primary agent.
    """

    def __init__(self, engine: Engine, home: str, session_id: str = "", hits: int = HITS, is_threat: Callable[[str], bool] | None = None, writes: bool = True) -> None:
        self.engine, self.home, self.session_id, self.writes = engine, home, session_id, writes
        self.hits = max(1, min(hits, MOST_HITS))
        self.is_threat = is_threat or (lambda text: False)
        self.recalled = 0

    def start(self) -> None:
        """Reads the agent's curated memory files."""
        for name in ("MEMORY.md", "USER.md"):
            self.remember(name)

    def remember(self, name: str) -> None:
        """Reads a curated memory file anew, after the agent has written it."""
        path = os.path.join(self.home, "memories", name)
        if os.path.isfile(path):
            self.engine.ingest(sources=[path])

    def prefetch(self, question: str) -> str:
        """Evidence for a question as text, at most ``hits`` excerpts; empty where there is none or the search fails."""
        self.recalled = 0
        if not question.strip():
            return ""
        try:
            found = self.engine.search_hits(question, 24).collect()
        except Exception:
            return ""
        lines: list[str] = []
        for r in found:
            said = (r["excerpt"] or "").strip()
            if said and not self.is_threat(said):
                lines.append(f"- [{r['node_type'] or 'source'}] {r['label'] or 'Untitled'}: {said}" + (f" — {r['path']}" if r["path"] else ""))
            if len(lines) == self.hits:
                break
        self.recalled = len(lines)
        return "## Evidence\n" + "\n".join(lines) if lines else ""

    def sync_turn(self, question: str, answer: str, session_id: str = "") -> str | None:
        """Keeps a question and its answer as a record of the session and reads it; the file's path, or None where nothing is kept."""
        name = session_id or self.session_id or "unknown"
        return self._keep(name, "agent", question, answer, ("user", "assistant"), {})

    def on_delegation(self, task: str, result: str, session_id: str = "") -> str | None:
        """Keeps a task given to another agent, and its result, as a session of its own."""
        return self._keep(session_id or f"delegation-{uuid.uuid4().hex}", "agent-delegation", task, result, ("task", "result"), {"parent_session_id": self.session_id})

    def _keep(self, name: str, source: str, first: str, second: str, marks: tuple[str, str], more: dict) -> str | None:
        if not self.writes or not first.strip() or not second.strip():
            return None
        now = int(time.time() * 1000)
        ids = [f"{now}-{m}-{uuid.uuid4().hex[:8]}" for m in marks]
        messages = [{"id": i, "role": r, "content": c, "timestamp": now + k} for k, (i, r, c) in enumerate(zip(ids, ("user", "assistant"), (first, second)))]
        path = append_record(os.path.join(self.home, "AgentSessions"), name, {"id": name, "session_id": name, "source": source, **more, "messages": messages})
        self.engine.ingest(sources=[path], kind="agent-session")
        return path


def append_record(folder: str, session_id: str, record: dict) -> str:
    """Appends a record to a session's file, under a lock, for its owner only; the path."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    path = os.path.join(folder, (re.sub(r"[^a-zA-Z0-9._-]", "-", session_id)[:100] or "unknown") + ".jsonl")
    with open(path, "a", encoding="utf-8") as f:
        fcntl.flock(f.fileno(), fcntl.LOCK_EX)
        f.write(json.dumps(record, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
        fcntl.flock(f.fileno(), fcntl.LOCK_UN)
    os.chmod(path, 0o600)
    return path
