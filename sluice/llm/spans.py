"""Spans of regular expressions in text columns, with DataFrame functions only.

Positions are code points, ends exclusive. They come from what split() leaves between the matches, so each row costs two
passes of the expression and running sums over as many numbers as it has matches. No lambda here reads a column other than
the text itself: the planner may put a column's expression in the place of its name, and would run it again for each match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<start:int,end:int,value:string>"
SPAN = f"array<{ITEM}>"
#: Numbers of a block in running(), and code points of a piece in pieces().
BLOCK, WIDTH = 128, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What `combine`, which is associative and has 0 as its zero, makes of an array of numbers up to each place.

    aggregate() copies its state at every step, so the array is built in blocks, which begin with what those before made.
    """

    def within(block: Column, first: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda made, v: F.array_append(made, combine(F.coalesce(F.get(made, F.size(made) - 1), first), v)))

    def whole(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, BLOCK))
        return F.when(F.size(x) <= BLOCK, within(x, F.lit(0))).otherwise(let(blocks, joined))

    def joined(blocks: Column) -> Column:
        totals = within(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine)), F.lit(0))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, k: within(b, F.coalesce(F.get(t, k - 1), F.lit(0))))))

    return let(values, whole)


def _found(text: Column, gate: Column, regex: str, test: Callable[[Column], Column]) -> Column:
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, regex, -1), F.length)
        # Behind the last match there is a gap only.
        reaches = F.transform(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda z: z["g"] + F.coalesce(F.length(z["m"]), F.lit(0)))
        ends = running(reaches, lambda a, b: a + b)
        made = F.transform(
            F.arrays_zip(found.alias("m"), ends.alias("e")),
            lambda z: F.when(z["m"].isNotNull(), F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("value"))),
        )
        return F.when(F.size(found) > 0, F.filter(made, lambda s: s.isNotNull() & test(s["value"]))).otherwise(none)

    return let(F.when(gate, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>")), placed)


def matches(df: DataFrame, text: Column, patterns: dict[str, tuple[Column, str, Callable[[Column], Column]]]) -> DataFrame:
    """df with an array of spans for each kind: its leftmost non-overlapping matches that pass the kind's test.

    patterns: kind -> (a cheap condition that every match implies, the expression, the test of a matched string).
    """
    return df.withColumns({k: _found(text, *how) for k, how in patterns.items()})


def ranked(kind: str, rank: int) -> Column:
    """A kind's spans with a rank, in an order that sorts by start, then rank."""
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))


def _reach(items: Column) -> Column:
    """The largest end up to each item."""
    return running(F.transform(items, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def apart(kind: str, others: list[str]) -> Column:
    """The spans of the column `kind`, which don't overlap one another, that meet no span of the columns `others`."""

    def kept(items: Column) -> Column:
        reach = running(F.transform(items, lambda s: F.when(s["rank"] == 0, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        return F.filter(let(reach, lambda r: F.transform(items, lambda s, i: alone(s, F.get(r, i), F.get(items, i + 1)))), lambda s: s.isNotNull())

    def alone(s: Column, reach: Column, following: Column) -> Column:
        # Those of `kind` are apart, so what starts later and meets this one comes next.
        met = F.coalesce((following["rank"] == 0) & (following["start"] < s["end"]), F.lit(False))
        own = (s["rank"] == 1) & (reach <= s["start"]) & ~met
        return F.when(own, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    items = F.sort_array(F.concat(*(ranked(k, 0) for k in others), ranked(kind, 1)))
    some = sum((F.size(k) for k in others), F.lit(0)) > 0
    return F.when((F.size(kind) > 0) & some, let(items, kept)).otherwise(F.col(kind))


def _marked(kinds: list[str]) -> Column:
    """All spans of the columns with their kinds, by start, then kind as listed."""
    one = lambda i, k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))
    return F.sort_array(F.concat(*(one(i, k) for i, k in enumerate(kinds))))


def listed(kinds: list[str]) -> Column:
    """All spans of the columns `kinds` as strings kind:start:end, by start, then kind as listed."""
    return F.array_join(F.transform(_marked(kinds), lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def pieces(text: Column) -> Column:
    """The text in pieces of WIDTH code points, so that a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0))


def _piece(parts: Column, at: Column) -> Column:
    return F.coalesce(F.get(parts, F.floor(at / WIDTH).cast("int")), F.lit(""))


def before(parts: Column, at: Column, n: int) -> Column:
    """The last n (at most WIDTH) code points of a text before place `at`; parts: its pieces()."""
    return F.substring(F.concat(_piece(parts, at - WIDTH), F.substring(_piece(parts, at), F.lit(1), at % WIDTH)), -n, n)


def after(parts: Column, at: Column, n: int) -> Column:
    """The first n (at most WIDTH) code points of a text from place `at` on."""
    return F.substring(F.concat(F.substring(_piece(parts, at), at % WIDTH + 1, F.lit(WIDTH)), _piece(parts, at + WIDTH)), 1, n)


def _between(parts: Column, start: Column, end: Column) -> Column:
    first, last = F.floor(start / WIDTH).cast("int"), F.floor(end / WIDTH).cast("int")
    within = F.substring(_piece(parts, start), start % WIDTH + 1, end - start)
    across = F.concat(
        F.substring(_piece(parts, start), start % WIDTH + 1, F.lit(WIDTH)),
        F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(_piece(parts, end), F.lit(1), end % WIDTH),
    )
    return F.when(first == last, within).otherwise(across)


def replaced(text: Column, kinds: list[str]) -> Column:
    """The text with each span of the columns replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    end = F.array(F.struct(*(v.alias(c) for c, v in (("start", F.length(text)), ("rank", F.lit(len(kinds))), ("end", F.length(text)), ("kind", F.lit(""))))))

    def joined(parts: Column, items: Column, reach: Column) -> Column:
        def cut(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))
            sign = F.when(s["kind"] == "", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
            return F.when(s["start"] >= at, F.concat(_between(parts, at, s["start"]), sign)).otherwise("")

        return F.array_join(F.transform(items, cut), "")

    done = let(F.concat(_marked(kinds), end), lambda items: let(_reach(items), lambda reach: let(pieces(text), lambda parts: joined(parts, items, reach))))
    return F.when(sum((F.size(k) for k in kinds), F.lit(0)) > 0, done).otherwise(text)
