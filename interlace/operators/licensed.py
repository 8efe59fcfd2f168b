"""Licensed forms in texts: exact, contained, ambiguous; repair of unknown segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.functions import annotation as A
from interlace.functions.text import blank, strip
from interlace.plans.storage import fits, written


def exact(sentences: DataFrame, lexicon: DataFrame, columns: Sequence[str] = ("form2",)) -> DataFrame:
    """(sentence_id, lexeme_id, surface): lexemes of a sentence's region of which a form, in any of the columns, is one of its segments.
    Of a segmented form the whole counts."""
    surfaces = sentences.where(~blank("segmented")).select("sentence_id", F.col("dialect_region").alias("region"), F.explode(A.morph_surfaces("segmented")).alias("surface"))
    each = F.explode(F.array_distinct(F.array(*[F.replace(strip(c), F.lit("-"), F.lit("")) for c in columns])) if len(columns) > 1 else F.array(strip(columns[0])))
    forms = lexicon.select("lexeme_id", "region", each.alias("surface")).where("surface <> ''").distinct()
    return surfaces.join(forms, ["region", "surface"]).select("sentence_id", "lexeme_id", "surface").distinct()


#: Places of a text that are looked at in one row.
STRETCH = 256


def contained(texts: DataFrame, lexicon: DataFrame, key: str = "sentence_id", text: str = "text", shortest: int = 3) -> DataFrame:
    """(key, lexeme_id, form, n_occurrences, first_at): lexemes whose form, of at least `shortest` characters, lies anywhere in a text.

    Texts are cut into stretches of STRETCH places, each with as many characters more as the longest form needs, so that the cost is
    in proportion to the text. Every run of `shortest` characters of a stretch meets the forms that begin with it by equality, the
    forms being broadcast only if their measured size allows; the rest of the form is compared, and cut out, only where they meet.
    """
    forms = written(lexicon.select("lexeme_id", strip("form2").alias("form")).where(F.length("form") >= shortest).distinct(), "forms")
    longest = forms.select(F.max(F.length("form"))).first()[0] or shortest
    seeds = forms.withColumn("seed", F.substring("form", 1, shortest))
    t = texts.select(key, F.split(text, "").alias("c")).where(F.size("c") >= shortest)
    cut = F.transform(F.sequence(F.lit(0), F.size("c") - shortest, F.lit(STRETCH)), lambda at: F.struct(at.alias("base"), F.array_join(F.slice("c", at + 1, STRETCH + longest - 1), "").alias("part")))
    parts = t.select(key, F.explode(cut).alias("s")).select(key, "s.base", "s.part")
    places = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.lit(STRETCH - 1), F.length("part") - shortest)))).withColumn("seed", F.substring("part", F.col("i") + 1, F.lit(shortest)))
    small = fits(forms, "octet_length(form) * 2 + 24")
    if not small:  # what is shuffled is as long as the longest form
        places = places.select(key, "base", "i", "seed", F.substring("part", F.col("i") + 1, F.lit(longest)).alias("part"))
    start = F.col("i") + 1 if small else F.lit(1)
    hits = places.join(F.broadcast(seeds) if small else seeds, "seed").where(F.substring("part", start, F.length("form")) == F.col("form"))
    return hits.groupBy(key, "lexeme_id", "form").agg(F.count("*").alias("n_occurrences"), F.min(F.col("base") + F.col("i")).alias("first_at"))


def ambiguity(lexicon: DataFrame) -> DataFrame:
    """(region, surface, analyses, n_lexemes): how many analyses a surface has; more than one can't be applied unasked."""
    rows = lexicon.select("region", strip("form2").alias("surface"), F.coalesce(F.nullif(strip("form2_seg"), F.lit("")), strip("form2")).alias("seg"), strip("annotation").alias("ann"), "lexeme_id").where("surface <> '' and ann <> ''")
    return rows.groupBy("region", "surface").agg(F.count_distinct("seg", "ann").alias("analyses"), F.count_distinct("lexeme_id").alias("n_lexemes"))


def repaired(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(sentence_id, segmented, annotation): sentences with exactly one unknown segment, whose surface has exactly one analysis of as
    many segments as labels in the sentence's dialect; the analysis stands in its place."""
    lex = lexicon.select("dialect_id", strip("form2").alias("surface"), F.coalesce(F.nullif(strip("form2_seg"), F.lit("")), strip("form2")).alias("seg"), strip("annotation").alias("ann"))
    lex = lex.where((F.col("surface") != "") & (F.col("ann") != "") & (F.size(F.split("seg", "-")) == F.size(F.split("ann", "-"))))
    one = lex.groupBy("dialect_id", "surface").agg(F.count_distinct("seg", "ann").alias("n"), F.max(F.struct("seg", "ann")).alias("a")).where("n = 1").select("dialect_id", "surface", "a.seg", "a.ann")
    fit = sentences.where(~blank("segmented") & ~blank("annotation") & A.alignment_error("segmented", "annotation").isNull())
    flat = fit.select("sentence_id", "dialect_id", A.skeleton("segmented").alias("s"), A.skeleton("annotation").alias("a"))
    places = F.flatten(F.transform("a", lambda p, i: F.filter(F.transform(p, lambda v, k: F.struct(i.alias("phrase"), k.alias("segment"), v.alias("label"))), lambda x: x["label"] == A.UNKNOWN)))
    open_ = flat.withColumn("u", places).where(F.size("u") == 1).withColumns({"i": F.get("u", F.lit(0))["phrase"], "k": F.get("u", F.lit(0))["segment"]})
    found = open_.withColumn("surface", F.get(F.get("s", F.col("i")), F.col("k"))).join(one, ["dialect_id", "surface"])
    put = lambda c, new: F.array_join(F.transform(c, lambda p, i: F.array_join(F.when(i == F.col("i"), A.splice(p, F.col("k"), F.split(new, "-"))).otherwise(p), "-")), " ")
    return found.select("sentence_id", put("s", "seg").alias("segmented"), put("a", "ann").alias("annotation"))


def unapplied(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(sentence_id, lexeme_id): licensed lexemes found exactly whose analysis the sentence doesn't contain."""
    found = exact(sentences, lexicon)
    lex = lexicon.groupBy("lexeme_id").agg(F.max(F.struct(F.coalesce(F.nullif(strip("form2_seg"), F.lit("")), strip("form2")).alias("seg"), strip("annotation").alias("ann"))).alias("l")).select("lexeme_id", "l.*")
    texts = sentences.select("sentence_id", "segmented", "annotation")
    joined = found.join(lex, "lexeme_id").join(texts, "sentence_id")
    return joined.where(~F.coalesce(A.contains_analysis(F.col("segmented"), F.col("annotation"), F.col("seg"), F.col("ann")), F.lit(False))).select("sentence_id", "lexeme_id")
