"""Rubric combinators and reward resolution as Column builders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequential(scores: list[Column]) -> Column:
    """0 where any score but the last is 0, else the last."""
    passed = reduce(lambda a, b: a & b, [s != 0 for s in scores[:-1]], F.lit(True))
    return F.when(passed, scores[-1]).otherwise(0.0)


def gate(score: Column, threshold: float) -> Column:
    return F.when(score < threshold, 0.0).otherwise(score)


def weighted_sum(parts: list[tuple[Column, float]]) -> Column:
    if abs(sum(w for _, w in parts) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    return reduce(lambda a, b: a + b, [s * w for s, w in parts])


def resolve_reward(trace: Column, verifier: Column) -> Column:
    """The last reward of a trace, or the verifier's; a conflict of the two, and neither, fail."""
    last = F.try_element_at(F.filter(trace, lambda r: r.isNotNull()), F.lit(-1))
    close = F.abs(last - verifier) <= F.greatest(1e-9 * F.greatest(F.abs(last), F.abs(verifier)), F.lit(1e-6))
    conflict = F.raise_error(F.lit("rewards of trace and verifier differ")).cast("double")
    none = F.raise_error(F.lit("no reward")).cast("double")
    return F.when(last.isNull() & verifier.isNull(), none).when(last.isNotNull() & verifier.isNotNull() & ~close, conflict).otherwise(F.coalesce(last, verifier))


class Rubric:
    """A named score of an action and an observation, built as a Column; children with weights make a composite.

    `forward` gets the columns of action and observation. Hooks run when the expression is built: `before` gets (rubric, action,
    observation), `after` also the score and may give another in its place.
    """

    def __init__(self, name: str, forward: Callable[[Column, Column], Column] | None = None, children: list[tuple[Rubric, float]] | None = None):
        if (forward is None) == (children is None):
            raise ValueError("a rubric has either a forward function or children")
        self.name, self.forward, self.children = name, forward, children or []
        self._before: list[Callable] = []
        self._after: list[Callable] = []

    def before(self, hook: Callable) -> Rubric:
        self._before.append(hook)
        return self

    def after(self, hook: Callable) -> Rubric:
        self._after.append(hook)
        return self

    def __call__(self, action: Column, observation: Column) -> Column:
        for hook in self._before:
            hook(self, action, observation)
        score = self.forward(action, observation) if self.forward else weighted_sum([(r(action, observation), w) for r, w in self.children])
        for hook in self._after:
            made = hook(self, action, observation, score)
            score = score if made is None else made
        return score

    def named(self, path: str = "") -> list[tuple[str, Rubric]]:
        """This rubric and all below it, by path."""
        own = f"{path}/{self.name}" if path else self.name
        return [(own, self), *(x for r, _ in self.children for x in r.named(own))]

    def scored(self, df: DataFrame, action: Column, observation: Column) -> DataFrame:
        """df with the scores of this rubric and of all below it, by path; hooks of each run for this score only."""
        below = {p: (r.forward(action, observation) if r.forward else weighted_sum([(c.forward(action, observation) if c.forward else c(action, observation), w) for c, w in r.children])) for p, r in self.named()[1:]}
        return df.withColumns({self.name: self(action, observation), **below})
