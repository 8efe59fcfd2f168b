"""Column functions on interlinear strings: phrases part at blanks, segments at hyphens, atoms at semicolons.

Null counts as an empty string throughout, so every function gives an empty array, an empty text or zero for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from interlace.functions.text import strip

#: Control IDs that aren't evaluated; the label of an unknown segment.
CONTROL = ("r",)
UNKNOWN = "?"


def _text(col: Column | str) -> Column:
    return F.coalesce(col, F.lit(""))


def phrases(col: Column | str) -> Column:
    """The phrases of an interlinear string."""
    return F.filter(F.split(_text(col), r"(?U)[\s\x{3000}]+"), lambda p: p != "")


def annotation_ids(col: Column | str) -> Column:
    """The IDs of an annotation in order, without control IDs."""
    return F.filter(F.split(_text(col), r"(?U)[\s\x{3000}\-;]+"), lambda t: (t != "") & ~t.isin(*CONTROL))


def labels(col: Column | str) -> Column:
    """The segments' labels of one phrase, without control IDs; their atoms stay together."""
    return F.filter(F.split(_text(col), "-"), lambda t: (t != "") & ~t.isin(*CONTROL))


def skeleton(col: Column | str) -> Column:
    """Phrases, each an array of its segments."""
    return F.transform(phrases(col), lambda p: F.split(p, "-"))


def segments(col: Column | str) -> Column:
    """All segments in order, over phrase boundaries."""
    return F.flatten(skeleton(col))


def alignment_error(segmented: Column | str, annotation: Column | str) -> Column:
    """Why surfaces and annotation can't be aligned, or null: phrase counts, then phrase by phrase an empty segment, segment counts."""
    s, a = skeleton(segmented), skeleton(annotation)

    def wrong(x: Column, y: Column) -> Column:
        return F.when(F.exists(x, lambda v: v == ""), F.lit("empty segment")).when(F.size(x) != F.size(y), F.concat(F.lit("segment count "), F.size(x).cast("string"), F.lit(" for "), F.size(y).cast("string")))

    placed = F.transform(F.zip_with(s, a, wrong), lambda e, i: F.concat(e, F.lit(" in phrase "), (i + 1).cast("string")))
    first = F.get(F.filter(placed, lambda e: e.isNotNull()), F.lit(0))
    counts = F.concat(F.lit("phrase count "), F.size(s).cast("string"), F.lit(" for "), F.size(a).cast("string"))
    return F.when(F.size(s) != F.size(a), counts).otherwise(first)


def sound_analysis(text: Column, segmented: Column, annotation: Column) -> Column:
    """Whether the segments, none of them empty, put together give the text, and align with the labels; phrases keep their blanks."""
    whole = F.forall(F.split(segmented, " "), lambda p: F.forall(F.split(p, "-"), lambda v: v != ""))
    return F.coalesce((segmented != "") & (annotation != "") & whole & (F.replace(segmented, F.lit("-"), F.lit("")) == text) & alignment_error(segmented, annotation).isNull(), F.lit(False))


def surface(segmented: Column | str) -> Column:
    """The text without blanks and segment boundaries."""
    return F.regexp_replace(_text(segmented), r"(?U)[\s\x{3000}\-]+", "")


def boundary_offsets(segmented: Column | str) -> Column:
    """Where, in code points of the surface, segments part; a boundary before the first letter is none."""
    joined = F.regexp_replace(_text(segmented), r"(?U)[\s\x{3000}]+", "")
    lengths = F.transform(F.split(joined, "-"), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(done: Column, n: Column) -> Column:
        return F.struct((done["at"] + n).alias("at"), F.concat(done["ends"], F.array(done["at"] + n)).alias("ends"))

    last = F.aggregate(lengths, start, step)
    inner = F.slice(last["ends"], F.lit(1), F.greatest(F.size(last["ends"]) - 1, F.lit(0)))
    return F.array_distinct(F.filter(inner, lambda n: n > 0))


def morph_surfaces(segmented: Column | str) -> Column:
    """Distinct segments, in the order in which they first occur."""
    return F.array_distinct(F.filter(segments(segmented), lambda v: v != ""))


def contains_analysis(segmented: Column, annotation: Column, need_segmented: Column, need_annotation: Column) -> Column:
    """Whether the segments of the need, with their labels, follow one another inside one phrase."""
    need_s, need_a = F.split(need_segmented, "-"), F.split(need_annotation, "-")
    n = F.size(need_s)

    def inside(x: Column, y: Column) -> Column:
        starts = F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda k: (F.slice(x, k, n) == need_s) & (F.slice(y, k, n) == need_a))

    return (n == F.size(need_a)) & F.exists(F.zip_with(skeleton(segmented), skeleton(annotation), inside), lambda v: F.coalesce(v, F.lit(False)))


def splice(values: Column, place: Column, new: Column) -> Column:
    """`values` with the element at `place` (from 0) replaced by the elements of `new`."""
    return F.concat(F.slice(values, F.lit(1), place), new, F.slice(values, place + 2, F.greatest(F.size(values) - place - 1, F.lit(0))))


#: Openings of a unit that show as another letter, and vowels, which show as nothing.
_ONSETS = (("tʃ", "t"), ("dʒ", "d"), ("ts", "t"), ("dz", "d"))
_VOWELS = "aiueoɿəː"


def compact_units(units: Column | str) -> Column:
    """Units in one text; a geminate mark (Q_...) shows as the onset of the next unit, or as itself where that has none."""
    arr = F.col(units) if isinstance(units, str) else units

    def show(unit: Column, i: Column) -> Column:
        after = F.coalesce(F.get(arr, i + 1), F.lit(""))
        onset = F.when((after == "") | F.substring(after, 1, 1).isin(*_VOWELS), unit)
        for opening, letter in _ONSETS:
            onset = onset.when(after.startswith(opening), F.lit(letter))
        return F.when(unit.startswith("Q_"), onset.otherwise(F.substring(after, 1, 1))).otherwise(unit)

    return F.array_join(F.transform(arr, show), "")


def english_key(col: Column | str) -> Column:
    """Lower-case letters and digits joined by underscores; not beginning with a digit."""
    key = F.btrim(F.regexp_replace(F.lower(_text(col)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(key.rlike("^[0-9]"), F.concat(F.lit("grammar_"), key)).otherwise(key)


def scoped_name(name: Column | str, target: Column | str, longest: int = 128) -> Column:
    """An English key ending in the target's; null where either is empty or nothing of the name is left."""
    end = F.concat(F.lit("_"), english_key(target))
    base = F.rtrim(F.substring(english_key(name), F.lit(1), F.greatest(F.lit(longest) - F.length(end), F.lit(0))), F.lit("_"))
    return F.when((base != "") & (F.length(end) > 1), F.concat(base, end))


#: Words that narrow a query to a region, taken out in this order; marks stripped from its ends.
HELPERS = ("方言", "琉球", "琉球語", "琉球諸語", "Miyako", "miyako")
STRIPPED = " 、,，・"


def sanitize_query(query: Column | str, region: Column | str) -> Column:
    """A Japanese query without scope words and region, blanks collapsed."""
    text = F.regexp_replace(strip(_text(query)), r"(?U)[\s\x{3000}]+", " ")
    for word in HELPERS:
        text = F.replace(text, F.lit(word), F.lit(" "))
    place = strip(_text(region))
    text = F.when(place == "", text).otherwise(F.replace(text, place, F.lit(" ")))
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(STRIPPED))


def compound_query(query: Column | str, region: Column | str) -> Column:
    """Whether a query, once sanitised, still has a blank inside: several searches put together."""
    return F.contains(sanitize_query(query, region), F.lit(" "))


def expression_rejected(expression: Column | str) -> Column:
    """Whether a corpus query is blank, over 256 characters, of more than 8 segments, or has a segment of no or more than 8 atoms."""
    text = strip(_text(expression))
    parts = F.split(text, "-")
    atoms = lambda p: F.size(F.filter(F.split(p, ";"), lambda a: strip(a) != ""))
    return (text == "") | (F.length(text) > 256) | (F.size(parts) > 8) | F.exists(parts, lambda p: (atoms(p) < 1) | (atoms(p) > 8))


def clip(col: Column | str, longest: int) -> Column:
    """At most so many characters, with an ellipsis where some are cut off."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("…"))).otherwise(c)


def bounded(col: Column | str) -> Column:
    """A number between 0 and 1; 0 for what is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((F.col(col) if isinstance(col, str) else col).try_cast("double"), F.lit(0.0))))


def single_surface(col: Column | str) -> Column:
    """The trimmed text where it is one segment of at most 255 characters, else an empty text."""
    text = strip(_text(col))
    return F.when((F.length(text) > 255) | text.rlike(r"(?U)[\s\-]"), "").otherwise(text)


def groundable(col: Column | str) -> Column:
    """Whether a label can be looked up: not blank, at most 128 characters, without blanks inside."""
    text = strip(_text(col))
    return (text != "") & (F.length(text) <= 128) & ~text.rlike(r"(?U)\s")


def positive_ids(col: Column | str) -> Column:
    """The distinct positive numbers of a comma-separated list, in order."""
    numbers = F.transform(F.split(_text(col), ","), lambda v: strip(v).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def example_note(source: Column, phrase: Column, translation: Column) -> Column:
    """One example in a note."""
    return F.concat(F.lit("例（文訳）: "), F.coalesce(source, F.lit("")), F.lit(" ["), F.coalesce(phrase, F.lit("")), F.lit("] → "), F.coalesce(translation, F.lit("")))
