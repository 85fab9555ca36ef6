"""Which matches of a rule fire now and which wait; limits on a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parser import ProgramError


class LimitReached(ProgramError):
    """A run went beyond its limit; the program is as it was before the step that did."""


class Scheduler:
    """Fires all matches. Override ``choose`` to hold some back; they are offered again in the next step."""

    def choose(self, rule, matches: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Matches to fire now, and those to keep."""
        return matches, None

    def can_stop(self, rules: list) -> bool:
        """Whether a step without changes means that nothing is left to do."""
        return True


class FirstN(Scheduler):
    """At most ``n`` matches of a rule in a step, those of least hash."""

    def __init__(self, n: int):
        self.n, self.waiting = n, {}

    def choose(self, rule, matches: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        if not matches.columns:
            return matches, None
        order = F.xxhash64(*[F.col(f"`{c}`") for c in matches.columns])
        now = matches.distinct().orderBy(order, *[F.col(f"`{c}`") for c in matches.columns]).limit(self.n)
        left = matches.distinct().exceptAll(now)
        self.waiting[rule.name] = bool(left.take(1))
        return now, left if self.waiting[rule.name] else None

    def can_stop(self, rules: list) -> bool:
        return not any(self.waiting.get(r.name) for r in rules)


class BackOff(Scheduler):
    """A rule with more than ``limit`` matches is banned for some steps; both double with each ban."""

    def __init__(self, limit: int = 1000, ban: int = 5):
        self.limit, self.ban = limit, ban
        self.bans: dict[str, int] = {}
        self.free_at: dict[str, int] = {}
        self.step = 0

    def choose(self, rule, matches: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        self.step += 1
        if self.step < self.free_at.get(rule.name, 0):
            return None, matches
        times = self.bans.get(rule.name, 0)
        most = self.limit << times
        if matches.limit(most + 1).count() > most:
            self.bans[rule.name] = times + 1
            self.free_at[rule.name] = self.step + (self.ban << times)
            return None, matches
        return matches, None

    def can_stop(self, rules: list) -> bool:
        """Not while a rule is banned; its ban ends at once where nothing else changes."""
        banned = [r.name for r in rules if self.free_at.get(r.name, 0) > self.step]
        for name in banned:
            self.free_at[name] = self.step
        return not banned
