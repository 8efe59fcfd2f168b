"""SQL fragments that the DuckDB statements of several queries share."""

from __future__ import annotations

_QUOTED = '''"(?:[^"]|"")*"|''[^'']*''|＂[^＂]*＂|＇[^＇]*＇|“[^”]*”|‘[^’]*’|„[^“”]*[“”]|‚[^‘’]*[‘’]|«[^»]*»|‹[^›]*›|「[^」]*」|『[^』]*』|｢[^｣]*｣|〝[^〞〟]*[〞〟]'''
_ORDINARY = r"[\p{L}\p{M}\p{Nd}:>._?]+"
_GAP = r"\s\p{Z}"
_BLANK = r"\s\p{Z}\x{FEFF}\x{200B}"


def packed_values(column: str) -> str:
    """DuckDB: the list of values packed in a text, an expression that is null for null."""
    raw = f"regexp_extract_all({column}, '{_QUOTED}|{_ORDINARY}')"
    bare = "CASE WHEN regexp_matches(v, '^[\"''＂＇“‘„‚«‹「『｢〝]') THEN replace(substring(v, 2, length(v) - 2), CASE WHEN v[1] = '\"' THEN '\"\"' ELSE '' END, CASE WHEN v[1] = '\"' THEN '\"' ELSE '' END) ELSE v END"
    return f"list_filter(list_transform({raw}, lambda v: {bare}), lambda v: v <> '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def blank(c: str) -> str:
    return f"(NOT regexp_matches(coalesce({c}, ''), '[^{_BLANK}]'))"


def phrases(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[{_GAP}]+'), lambda p: p <> '')"


def skeleton(c: str) -> str:
    return f"list_transform({phrases(c)}, lambda p: string_split(p, '-'))"


def ids(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[{_GAP}\\-;]+'), lambda t: t <> '' AND t <> 'r')"


def first_seen(x: str) -> str:
    """Distinct elements of a list in the order in which they first occur."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def surface(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[{_GAP}\\-]+', '', 'g')"


def offsets(c: str) -> str:
    """Boundary offsets of a segmented text."""
    parts = f"string_split(regexp_replace(coalesce({c}, ''), '[{_GAP}]+', '', 'g'), '-')"
    ends = f"list_transform({parts}[1:len({parts}) - 1], lambda v, i: length(array_to_string({parts}[1:i], '')))"
    return first_seen(f"list_filter({ends}, lambda n: n > 0)")


def alignment_error(s: str, a: str) -> str:
    """Of two skeletons."""
    each = f"""list_transform(range(1, len({s}) + 1), lambda i: CASE WHEN list_contains({s}[i], '') THEN 'empty segment in phrase ' || i
        WHEN len({s}[i]) <> len({a}[i]) THEN 'segment count ' || len({s}[i]) || ' for ' || len({a}[i]) || ' in phrase ' || i END)"""
    return f"CASE WHEN len({s}) <> len({a}) THEN 'phrase count ' || len({s}) || ' for ' || len({a}) ELSE list_filter({each}, lambda e: e IS NOT NULL)[1] END"


def distances(source: str) -> str:
    """(k, edits) of `source`, a CTE of (k, x, y) with lists of tokens."""
    new = """list_transform(range(0, len(y) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda m: t[m + 1] + j - m)))"""
    step = """list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(line[j + 1] + 1, line[j] + CASE WHEN x[i + 1] = y[j] THEN 0 ELSE 1 END) END)"""
    return f"""(WITH RECURSIVE d AS (SELECT k, x, y, 0::BIGINT AS i, range(0, len(y) + 1) AS line FROM {source}
        UNION ALL SELECT k, x, y, i + 1, {new} FROM (SELECT k, x, y, i, {step} AS t FROM d WHERE i < len(x)))
        SELECT k, line[len(y) + 1] AS edits FROM d WHERE i = len(x))"""


def alignments(source: str) -> str:
    """(k, o) of `source`, a CTE of (k, g, p): the errors of the best alignment as 'gold→predicted', cell by cell."""
    cell = """CASE WHEN g[i] = p[j + 1] THEN prev[j + 1]
        WHEN prev[j + 1].c <= prev[j + 2].c AND prev[j + 1].c <= cur[j + 1].c THEN {'c': prev[j + 1].c + 1, 'o': list_append(prev[j + 1].o, g[i] || '→' || p[j + 1])}
        WHEN prev[j + 2].c <= cur[j + 1].c THEN {'c': prev[j + 2].c + 1, 'o': list_append(prev[j + 2].o, g[i] || '→<missing>')}
        ELSE {'c': cur[j + 1].c + 1, 'o': list_append(cur[j + 1].o, '<extra>→' || p[j + 1])} END"""
    return f"""(WITH RECURSIVE d AS (SELECT k, g, p, 0::BIGINT AS i, len(p)::BIGINT AS j, list_transform(range(0, len(p) + 1), lambda m: {{'c': m, 'o': list_transform(p[1:m], lambda t: '<extra>→' || t)}}) AS cur, CAST(NULL AS STRUCT(c BIGINT, o VARCHAR[])[]) AS prev FROM {source}
        UNION ALL SELECT k, g, p, CASE WHEN j = len(p) THEN i + 1 ELSE i END, CASE WHEN j = len(p) THEN 0 ELSE j + 1 END,
            CASE WHEN j = len(p) THEN [{{'c': cur[1].c + 1, 'o': list_append(cur[1].o, g[i + 1] || '→<missing>')}}] ELSE list_append(cur, {cell}) END, CASE WHEN j = len(p) THEN cur ELSE prev END
        FROM d WHERE NOT (i = len(g) AND j = len(p)))
        SELECT k, cur[len(p) + 1].o AS o FROM d WHERE i = len(g) AND j = len(p))"""
