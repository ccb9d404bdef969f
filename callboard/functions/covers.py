"""Cover-density rank: how closely a text's words stand together for a query.

A cover is a shortest stretch of the text that meets the query: none of its parts does.  Each
cover adds 0.1 over one and the words in it that the query does not name; the sum w becomes w / (w + 1).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT = 0.1


def entries(stems: Column, asked: Column) -> Column:
    """array<struct<pos, stem>>: the places of asked stems in a text, in order."""
    placed = F.transform(stems, lambda s, k: F.struct(k.cast("int").alias("pos"), s.alias("stem")))
    return F.filter(placed, lambda e: F.array_contains(asked, e["stem"]))


def density(found: Column, groups: Sequence[Sequence[Column]]) -> Column:
    """The rank of ``entries`` for alternatives, each a list of terms that must all be there; a term is an
    array of stems that follow one another.  0 without a cover.

    One walk over the entries keeps where each term last began.  An alternative's stretch that ends here begins
    at the earliest of these, the query's at the latest over alternatives; it is a cover if it begins later
    than the cover before it.
    """
    terms = list({str(t): t for g in groups for t in g}.values())
    place = {str(t): k for k, t in enumerate(terms)}
    if not terms:
        return F.lit(0.0)

    def step(state: Column, k: Column) -> Column:
        def ends(term: Column) -> Column:
            low = k - F.size(term) + 1
            here = F.slice(found, F.greatest(low, F.lit(0)) + 1, F.size(term))
            return (low >= 0) & (F.transform(here, lambda e: e["stem"]) == term) & (found[k]["pos"] - found[F.greatest(low, F.lit(0))]["pos"] == F.size(term) - 1)

        return F.struct(F.array(*(F.when(ends(t), k - F.size(t) + 1).otherwise(state["last"][j]) for j, t in enumerate(terms))).alias("last"), state["begin"].alias("begin"), state["sum"].alias("sum"), k.alias("k"))

    def cover(state: Column) -> Column:
        of = lambda group: reduce(F.least, [state["last"][place[str(t)]] for t in group]) if len(group) > 1 else state["last"][place[str(group[0])]]
        begins = [of(g) for g in groups if g]
        return F.greatest(*begins) if len(begins) > 1 else begins[0]

    def counted(state: Column) -> Column:
        begin, k = cover(state), state["k"]
        noise = found[k]["pos"] - found[F.greatest(begin, F.lit(0))]["pos"] - (k - begin)
        return F.struct(state["last"].alias("last"), F.greatest(begin, state["begin"]).alias("begin"), (state["sum"] + F.when(begin > state["begin"], F.lit(WEIGHT) / (noise + 1)).otherwise(F.lit(0.0))).alias("sum"), k.alias("k"))

    none = F.struct(F.array(*[F.lit(-1)] * len(terms)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("sum"), F.lit(-1).alias("k"))
    places = F.filter(F.sequence(F.lit(0), F.size(found)), lambda k: k < F.size(found))
    total = F.aggregate(places, none, lambda s, k: F.transform(F.array(step(s, k)), counted)[0], lambda s: s["sum"])
    return total / (total + 1)
