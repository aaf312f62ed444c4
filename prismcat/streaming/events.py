"""Events of running jobs for those who follow them.

A follower has a bounded buffer.  When it is full, further events are dropped rather than holding up the job: the job's
row in the store is what counts, and a follower that comes back reads it there.  A quiet follower gets a heartbeat.
"""

from __future__ import annotations

import threading
from collections import deque

#: Events a follower may lag behind (a fixed value), and seconds between heartbeats.
BUFFER, HEARTBEAT = 1000, 15.0
END, BEAT = object(), object()


class Follower:
    """The events of one job, in order, for one reader."""

    def __init__(self, job_id: int, buffer: int = BUFFER):
        self.job_id, self.dropped = job_id, 0
        self._events: deque = deque()
        self._buffer, self._ended = buffer, False
        self._more = threading.Condition()

    def put(self, event) -> None:
        with self._more:
            if len(self._events) >= self._buffer or self._ended:
                self.dropped += 1
                return
            self._events.append(event)
            self._more.notify()

    def end(self) -> None:
        """No more events; a waiting reader wakes up."""
        with self._more:
            self._ended = True
            self._more.notify_all()

    def get(self, timeout: float = HEARTBEAT):
        """The next event, ``BEAT`` after so many quiet seconds, or ``END``."""
        with self._more:
            self._more.wait_for(lambda: self._events or self._ended, timeout)
            if self._events:
                return self._events.popleft()
            return END if self._ended else BEAT


class Fanout:
    """Passes the events of jobs on to their followers."""

    def __init__(self):
        self._followers: dict[int, list[Follower]] = {}
        self._lock = threading.Lock()

    def follow(self, job_id: int, buffer: int = BUFFER) -> Follower:
        follower = Follower(job_id, buffer)
        with self._lock:
            self._followers.setdefault(job_id, []).append(follower)
        return follower

    def leave(self, follower: Follower) -> None:
        with self._lock:
            rest = [f for f in self._followers.get(follower.job_id, []) if f is not follower]
            self._followers[follower.job_id] = rest
            if not rest:
                del self._followers[follower.job_id]
        follower.end()

    def send(self, job_id: int, event) -> None:
        with self._lock:
            followers = list(self._followers.get(job_id, ()))
        for f in followers:
            f.put(event)

    def close(self, job_id: int) -> None:
        """The job is over."""
        with self._lock:
            followers = self._followers.pop(job_id, [])
        for f in followers:
            f.end()
