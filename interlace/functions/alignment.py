"""Edit alignment of token arrays with higher-order functions: no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for no token on either side.
MISSING, EXTRA = "<missing>", "<extra>"
_ERRORS = "array<struct<gold:string,predicted:string>>"


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _costs(gold: Column, predicted: Column) -> Column:
    """The rows of the cost table, from that of no gold token on."""
    first = F.sequence(F.lit(0), F.size(predicted))

    def row(done: Column, i: Column) -> Column:
        above, g = F.element_at(done, -1), F.element_at(gold, i)

        def cell(line: Column, j: Column) -> Column:
            corner = F.element_at(above, j)
            cheapest = F.when(g == F.element_at(predicted, j), corner).otherwise(F.least(corner, F.element_at(above, j + 1), F.element_at(line, j)) + 1)
            return F.concat(line, F.array(cheapest))

        return F.concat(done, F.array(F.aggregate(_upto(F.size(predicted)), F.array(i), cell)))

    return F.aggregate(_upto(F.size(gold)), F.array(first), row)


def _errors(gold: Column, predicted: Column) -> Column:
    """The errors of the best alignment, in order. Equal tokens always match; otherwise the cheapest of substitution, deletion and
    insertion, in this order of preference. Costs alone are kept, and the errors are read off on the way back from the end."""
    costs = _costs(gold, predicted)

    def back(at: Column, _: Column) -> Column:
        i, j, table = at["i"], at["j"], at["table"]
        cost = lambda x, y: F.get(F.get(table, x), y)
        both = (i > 0) & (j > 0)
        g, p = F.get(gold, i - 1), F.get(predicted, j - 1)
        same = both & g.eqNullSafe(p)
        corner, over, left = F.when(both, cost(i - 1, j - 1)), F.when(i > 0, cost(i - 1, j)), F.when(j > 0, cost(i, j - 1))
        # along an edge of the table only one way is left
        change = both & (corner <= over) & (corner <= left)
        drop = (i > 0) & ((j == 0) | (over <= left))
        error = F.when(change, F.struct(g.alias("gold"), p.alias("predicted"))).when(drop, F.struct(g.alias("gold"), F.lit(MISSING).alias("predicted"))).otherwise(F.struct(F.lit(EXTRA).alias("gold"), p.alias("predicted")))
        done = F.when(same, at["errors"]).otherwise(F.concat(at["errors"], F.array(error)).cast(_ERRORS))
        up, aside = F.when(same | change | drop, 1).otherwise(0), F.when(same | change | ~drop, 1).otherwise(0)
        moved = F.struct((i - up).cast("int").alias("i"), (j - aside).cast("int").alias("j"), done.alias("errors"), table.alias("table"))
        return F.when((i == 0) & (j == 0), at).otherwise(moved)

    start = F.struct(F.size(gold).alias("i"), F.size(predicted).alias("j"), F.array().cast(_ERRORS).alias("errors"), costs.alias("table"))
    return F.reverse(F.aggregate(_upto(F.size(gold) + F.size(predicted)), start, back, lambda at: at["errors"]))


def trailing_matches(predicted: Column, gold: Column) -> Column:
    """How many tokens at the end of both are equal. The best alignment, read from its end, matches them first."""
    differ = F.array_position(F.zip_with(F.reverse(gold), F.reverse(predicted), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(gold)).otherwise(differ - 1).cast("int")


def align(predicted: Column, gold: Column, matched: Column | None = None) -> Column:
    """struct(matches, substitutions, insertions, deletions, edits, gold_ids, predicted_ids, confusions). `matched` more tokens were
    equal at the end of both and have been cut off. Equal arrays skip the table."""
    errors = F.when(predicted == gold, F.array().cast(_ERRORS)).otherwise(_errors(gold, predicted))
    more = F.lit(0) if matched is None else matched
    count = lambda keep: F.size(F.filter(errors, keep))
    extra, missing = count(lambda e: e["gold"] == EXTRA), count(lambda e: e["predicted"] == MISSING)
    return F.struct(
        (more + F.size(gold) - F.size(errors) + extra).alias("matches"), (F.size(errors) - extra - missing).alias("substitutions"), extra.alias("insertions"), missing.alias("deletions"),
        F.size(errors).alias("edits"), (more + F.size(gold)).alias("gold_ids"), (more + F.size(predicted)).alias("predicted_ids"), errors.alias("confusions"),
    )


def match_rate(matches: Column, gold: Column, predicted: Column) -> Column:
    """Matches by the longer side; 1 where both are empty."""
    return F.coalesce(F.try_divide(matches, F.greatest(gold, predicted)), F.lit(1.0))


def error_rate(edits: Column, gold: Column, predicted: Column) -> Column:
    """Edits by the gold's length; without gold 0 if there is no prediction either, else 1."""
    return F.when(gold > 0, edits / gold).when(predicted == 0, 0.0).otherwise(1.0)


#: A pair's distinct tokens become characters from this one on, without the surrogates; there are so many.
_FIRST, _SURROGATES, _CHARACTERS = 0x4E00, (0xD800, 0x800), 0x110000 - 0x4E00 - 0x800


def edit_distance(left: Column, right: Column) -> Column:
    """Token edit distance: each distinct token of the pair becomes a character, and the built-in distance does the rest. A pair of
    more distinct tokens than there are characters is an error, never a wrong distance."""
    words = F.array_distinct(F.concat(left, right))

    def coded(tokens: Column) -> Column:
        def character(t: Column) -> Column:
            n = F.array_position(words, t) + (_FIRST - 1)
            n = n + F.when(n >= _SURROGATES[0], _SURROGATES[1]).otherwise(0)
            return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

        return F.array_join(F.transform(tokens, character), "")

    many = F.raise_error(F.lit(f"edit_distance: more than {_CHARACTERS} distinct tokens in a pair")).cast("int")
    return F.when(left == right, 0).when(F.size(words) > _CHARACTERS, many).otherwise(F.levenshtein(coded(left), coded(right)))


def boundary_scores(predicted_surface: Column, predicted: Column, gold_surface: Column, gold: Column) -> Column:
    """struct of boundary counts and rates; where the surfaces differ, all boundaries are errors. Without any boundary on a side the
    rate falls back to 1, but precision to 0 where only the gold has boundaries."""
    same = predicted_surface == gold_surface
    hit = F.when(same, F.size(F.array_intersect(predicted, gold))).otherwise(0)
    false_positive, false_negative = F.size(predicted) - hit, F.size(gold) - hit
    precision = F.coalesce(F.try_divide(hit, F.size(predicted)), F.when(F.size(gold) == 0, 1.0).otherwise(0.0))
    recall = F.coalesce(F.try_divide(hit, F.size(gold)), F.lit(1.0))
    return F.struct(
        same.alias("surface_match"), (same & (false_positive == 0) & (false_negative == 0)).alias("exact"), F.size(gold).alias("gold_boundaries"), F.size(predicted).alias("predicted_boundaries"),
        hit.alias("correct"), false_positive.alias("false_positive"), false_negative.alias("false_negative"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
    )
