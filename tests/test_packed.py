import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from interlace.operators import packed
from tests.conftest import rows

TOKEN = re.compile(r'"((?:[^"]|"")*)"|' r"'([^']*)'|“([^”]*)”|「([^」]*)」|([^\W]|[:>._?̀-ͯ])+")


def brute(text):
    """Values of well-formed fields, by a pattern of its own."""
    out = []
    for m in TOKEN.finditer(text):
        if m.group(1) is not None:
            v = m.group(1).replace('""', '"')
        else:
            v = next((g for g in m.groups()[1:4] if g is not None), None)
            v = m.group(0) if v is None else v
        if v:
            out.append(v)
    return out


def split(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, f string")
    got = rows(packed.split_packed(df, ["k"], ["f"]))
    return [[v for _, _, _, v in sorted((r for r in got if r[0] == i), key=lambda r: r[2])] for i in range(len(texts))]


word = st.text("ab:>._?ï鳥7", min_size=1, max_size=4)
quoted = st.one_of(
    st.text("ab ;,-'漢", min_size=1, max_size=5).map(lambda s: '"' + s + '"'), st.text('ab"; ', min_size=1, max_size=4).map(lambda s: "'" + s + "'"), st.text("ab; -", min_size=1, max_size=4).map(lambda s: f"「{s}」"),
    st.text("ab -", min_size=1, max_size=4).map(lambda s: f'"{s}""{s}"'),
)
field = st.lists(st.tuples(st.one_of(word, quoted), st.sampled_from([" ", "-", ";", ", ", " | ", "　", "–", "] [", "\t"])), max_size=6).map(lambda xs: "".join(a + b for a, b in xs))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(field, min_size=20, max_size=40))
def test_against_pattern(spark, texts):
    assert split(spark, texts) == [brute(t) for t in texts]


def test_shapes(spark):
    texts = ["A;cvb-B C-dat", '["a", "b c", "d"]', "'l:na:z\"zu:\"'-akk", '"l:na""yu"""-x', "「x y」;z", "", "  ", "--;", '""', 'a"b', None, "x" * 50_000]
    assert split(spark, texts) == [["A", "cvb", "B", "C", "dat"], ["a", "b c", "d"], ['l:na:z"zu:"', "akk"], ['l:na"yu"', "x"], ["x y", "z"], [], [], [], [], ["a", "b"], [], ["x" * 50_000]]


def test_rules_resolve_once_per_skeleton(spark):
    assert packed.resolve('x"x x"; x') == [(0, 0, packed.BARE), (2, 4, packed.DOUBLED), (8, 8, packed.BARE)] and packed.resolve("'x") == [(1, 1, packed.BARE)] and packed.resolve("「x,」") == [(1, 2, packed.QUOTED)]
    df = spark.createDataFrame([("A-b;C",), ("d-e;f",), ("A-b C",), ("",), (None,), ("'a, b'",)], "f string")
    assert {r["skel"] for r in packed.rules_of(df, ["f"]).collect()} == {"x-x;x", "x-x x", "'x, x'"}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = ['"a b" c', "c d", None, "'e'"]
    small = split(spark, texts)
    monkeypatch.setattr(packed, "fits", lambda *a, **k: False)
    assert split(spark, texts) == small


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "a b", "r")], "row_id int, annotation string, rule string").withColumn("skel", packed.F.lit("s"))
    assert rows(packed.split_packed(df, ["row_id", "rule", "skel"], ["annotation"])) == [(1, "r", "s", "annotation", 0, "a"), (1, "r", "s", "annotation", 1, "b")]
    assert rows(packed.split_packed(df.limit(0), ["row_id"], ["annotation"])) == []
