"""One model server a machine, shared by all its tasks and stopped when nobody uses it.

A lease folder on the machine holds one state file under a lock: the server's keeper, its
address, and the processes that use it.  The first user picks a free port and starts a
keeper (this module as a program), which starts the server; the others find it there.  The
keeper stops the server once all users' processes have ended and a while has passed, so a
worker that is killed leaves nothing behind.  A server that died is started again by
whoever asks next.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import signal
import socket
import subprocess
import sys
import tempfile
import time
import urllib.request
from collections.abc import Iterator, Sequence

#: Seconds without users after which a server is stopped.
LINGER = 60.0


def lease_folder(name: str, command: Sequence[str]) -> str:
    """The folder of a server on this machine; another command is another server."""
    digest = hashlib.sha256("\0".join([name, *command]).encode()).hexdigest()[:16]
    path = os.path.join(os.environ.get("SERVED_LEASES", tempfile.gettempdir()), f"served-{os.getuid()}-{digest}")
    os.makedirs(path, mode=0o700, exist_ok=True)
    return path


@contextlib.contextmanager
def locked_state(folder: str) -> Iterator[dict]:
    """The state under the folder's lock; what is changed in it is written at the end."""
    with open(os.path.join(folder, "lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        path = os.path.join(folder, "state.json")
        try:
            with open(path) as f:
                state = json.load(f)
        except (OSError, ValueError):
            state = {}
        yield state
        with open(f"{path}.new", "w") as f:
            json.dump(state, f)
        os.replace(f"{path}.new", path)


def born(pid: int) -> str | None:
    """When a process began, as the system counts; none if it has ended.  Tells a reused number apart."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            fields = f.read().rpartition(")")[2].split()
        return None if fields[0] == "Z" else fields[19]
    except OSError:
        return None


def living(users: dict[str, str | None]) -> dict[str, str | None]:
    return {pid: start for pid, start in users.items() if start and born(int(pid)) == start}


def free_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def ready(url: str, health: str) -> bool:
    try:
        with urllib.request.urlopen(url.rstrip("/") + health, timeout=5):
            return True
    except OSError:
        return False


def acquire(name: str, url: str, command: Sequence[str], patience: float = 600.0, health: str = "/health", linger: float = LINGER) -> str:
    """The address of the machine's server, started if need be; this process counts as its user until it ends or releases.

    ``{port}`` in the address and the command stands for a free port.
    """
    folder, me, end = lease_folder(name, command), str(os.getpid()), time.monotonic() + patience
    while True:
        with locked_state(folder) as state:
            state["users"] = living(state.get("users", {})) | {me: born(os.getpid())}
            if not state.get("keeper") or born(state["keeper"]) != state.get("keeper_born"):
                port = str(free_port())
                state["url"] = url.replace("{port}", port)
                root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
                env = os.environ | {"PYTHONPATH": os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])}
                started = [sys.executable, "-m", "palimpsest.operators.served", folder, str(linger), *[c.replace("{port}", port) for c in command]]
                keeper = subprocess.Popen(started, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True, env=env)
                state["keeper"], state["keeper_born"] = keeper.pid, born(keeper.pid)
                state["starts"] = state.get("starts", 0) + 1
            address, keeper_id = state["url"], (state["keeper"], state["keeper_born"])
        while born(keeper_id[0]) == keeper_id[1]:
            if ready(address, health):
                return address
            if time.monotonic() > end:
                break
            time.sleep(0.1)
        if time.monotonic() > end:
            release(name, command)
            raise RuntimeError(f"the server did not get ready: {' '.join(command)}")
        time.sleep(0.5)  # it ended before it was ready: try again


def release(name: str, command: Sequence[str]) -> None:
    """This process no longer uses the server."""
    with locked_state(lease_folder(name, command)) as state:
        state.get("users", {}).pop(str(os.getpid()), None)


def keep(folder: str, linger: float, command: Sequence[str]) -> None:
    """Run the server while somebody uses it."""
    server = subprocess.Popen(list(command), stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    last = time.monotonic()
    try:
        while server.poll() is None:
            time.sleep(min(1.0, linger / 4))
            with locked_state(folder) as state:
                state["users"] = living(state.get("users", {}))
                if state["users"]:
                    last = time.monotonic()
                elif time.monotonic() - last > linger:
                    state.pop("keeper", None)  # whoever comes now starts another
                    break
    finally:
        server.terminate()
        try:
            server.wait(10)
        except subprocess.TimeoutExpired:
            server.kill()


if __name__ == "__main__":
    signal.signal(signal.SIGTERM, lambda *_: sys.exit(0))
    keep(sys.argv[1], float(sys.argv[2]), sys.argv[3:])
