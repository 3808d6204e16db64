"""Untrusted code in a child process with limits, killed at its deadline.

One child serves many jobs of a task, one JSON line each; it is replaced when a job exceeds its time or
kills it. A job is (code, steps); the child executes the code in a fresh namespace and evaluates the steps:

    call    {"pick": {"name": ..} or {"contains": [..]}, "args": [..]}  ->  {"ok", "value", "after", "error"}
    script  {"pick": .., "operations": [{"op", "args", "expected"?}, ..]}  a class, made and driven

Values travel as JSON; what JSON can't hold travels as its repr.
"""

from __future__ import annotations

import json
import os
import select
import subprocess
import sys
from typing import Any

_CHILD = r"""
import json, sys, resource, io
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
real, sys.stdout = sys.stdout, io.StringIO()
def plain(v):
    try:
        json.dumps(v)
        return v
    except (TypeError, ValueError):
        return repr(v)
def pick(space, how, kind):
    found = [(n, v) for n, v in space.items() if not n.startswith("__") and callable(v) and isinstance(v, type) == (kind == "class")]
    for n, v in found:
        if n == how.get("name") or any(k in n.lower() for k in how.get("contains", ())):
            return v
    return found[0][1] if found and how.get("any") else None
for line in sys.stdin:
    job, out = json.loads(line), []
    sys.stdout = io.StringIO()
    try:
        space = {"__name__": "candidate"}
        exec(compile(job["code"], "<candidate>", "exec"), space)
    except BaseException as e:
        real.write(json.dumps({"error": type(e).__name__ + ": " + str(e)[:200]}) + "\n"); real.flush()
        continue
    for s in job["steps"]:
        try:
            if "operations" in s:
                kind, obj, got = pick(space, s["pick"], "class"), None, []
                if kind is None:
                    raise LookupError("no class")
                for o in s["operations"]:
                    if o["op"] == "init":
                        obj = kind(*o.get("args", []))
                        got.append(None)
                    else:
                        got.append(plain(getattr(obj, o["op"])(*o.get("args", []))))
                out.append({"ok": True, "value": got})
            else:
                f, args = pick(space, s["pick"], "function"), json.loads(json.dumps(s["args"]))
                if f is None:
                    raise LookupError("no function")
                v = f(*args)
                out.append({"ok": True, "value": plain(v), "after": plain(args[0]) if args else None})
        except BaseException as e:
            out.append({"ok": False, "error": type(e).__name__, "message": str(e)[:200]})
    real.write(json.dumps({"results": out}) + "\n"); real.flush()
"""


class Sandbox:
    """A child process that runs jobs; use as a context manager."""

    def __init__(self, seconds: float = 5.0):
        self.seconds = seconds
        self._child: subprocess.Popen | None = None

    def __enter__(self) -> Sandbox:
        return self

    def __exit__(self, *_: object) -> None:
        self._stop()

    def _stop(self) -> None:
        if self._child:
            self._child.kill()
            self._child.wait()
            for pipe in (self._child.stdin, self._child.stdout):
                pipe.close()
            self._child = None

    def run(self, code: str, steps: list[dict]) -> dict[str, Any]:
        """{"results": [..]} or {"error": ..}; a job over its time gives {"error": "timeout"}."""
        if self._child is None:
            self._child = subprocess.Popen([sys.executable, "-I", "-S", "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={"PATH": os.defpath}, cwd="/")
        try:
            self._child.stdin.write(json.dumps({"code": code, "steps": steps}).encode() + b"\n")
            self._child.stdin.flush()
        except OSError:
            self._stop()
            return {"error": "the sandbox ended"}
        ready, _, _ = select.select([self._child.stdout], [], [], self.seconds)
        line = self._child.stdout.readline() if ready else b""
        if not line:
            ended = bool(ready)
            self._stop()
            return {"error": "the sandbox ended" if ended else "timeout"}
        return json.loads(line)
