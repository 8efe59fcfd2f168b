"""Splitting oversized items at natural boundaries: a sparse-table range-maximum index over boundary strengths.

Each place between two tokens of a text has a strength: paragraph, line, sentence, clause, word, none; a place inside a character
can't be cut. A sparse table gives the strongest cut in any window in two look-ups. From a piece's beginning, the window runs from
half the limit to the limit; the strongest cut in it ends the piece, the rightmost of equals. Where that is only a word's end, or
none, a stronger cut in the half before it is taken instead, if there is one. The next piece begins the overlap's tokens before the cut, or before the character that would be cut in two.

A piece's tokens are those of the whole text: places between byte-pair tokens stay places between tokens when a piece is tokenized
alone, so a piece doesn't exceed the limit then either.

Defined cases: null texts give no pieces; an empty text gives one empty piece; a text within the limit, or of a language without one,
comes out whole; a limit not above the overlap is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.llm.tokens import TOKENIZER, encoding

#: Marks that end a sentence where a blank (or a capital) follows, or anyway; marks that end a clause anyway, or where a
#: blank follows (within a word a colon is a length mark); marks that close either.
SENTENCE_BLANK, SENTENCE, CLAUSE, CLAUSE_BLANK, CLOSING = ".!?…．", "。！？｡", ",;、，；､", ":：", "\"'”’」』）)]］»"
#: Limits for up to so many groups are broadcast.
GROUPS = 100_000
PARAGRAPH_CUT, LINE_CUT, SENTENCE_CUT, CLAUSE_CUT, WORD_CUT, ANY_CUT, NO_CUT = 5, 4, 3, 2, 1, 0, -1


BLANKS = "\t\n\v\f\r \x85\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u3000"
_KINDS = (BLANKS, CLOSING, SENTENCE_BLANK, SENTENCE, CLAUSE, CLAUSE_BLANK, "".join(map(chr, [*range(0x41, 0x5B), *range(0xFF21, 0xFF3B)])), "0123456789")
_BLANK, _CLOSING, _SENTENCE_BLANK, _SENTENCE, _CLAUSE, _CLAUSE_BLANK, _CAPITAL, _DIGIT, _KANA, _LINE = (1 << k for k in range(10))
_KIND = np.zeros(0x10000, np.uint16)  # what a character is, as bits; none of these is above
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] |= 1 << _k
_KIND[0x3041:0x30A0] |= _KANA
_KIND[10] |= _LINE


def strengths(chars: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How natural a cut before chars[place] is, for places from 1 to len(chars) - 1."""
    kinds = _KIND[np.minimum(chars, 0xFFFF)]
    left, right, left2 = kinds[places - 1], kinds[places], kinds[np.maximum(places - 2, 0)]
    mark = np.where(left & _CLOSING, left2, left)
    is_ = lambda x, bits: (x & bits) != 0
    blank = is_(right, _BLANK)
    out = np.full(len(places), ANY_CUT, np.int64)
    out[blank | is_(left, _BLANK) | (is_(left, _KANA) & ~is_(right, _KANA))] = WORD_CUT
    bare = is_(mark, _SENTENCE_BLANK) & ~is_(right, _DIGIT | _CLOSING | _SENTENCE_BLANK)
    out[bare | is_(left, _CLAUSE) | (is_(left, _CLAUSE_BLANK) & blank)] = CLAUSE_CUT
    sentence = is_(mark, _SENTENCE) & ~is_(right, _CLOSING | _SENTENCE)
    sentence |= is_(mark, _SENTENCE_BLANK) & is_(right, _BLANK | _CAPITAL)
    sentence |= is_(left, _BLANK) & is_(left2, _SENTENCE_BLANK | _SENTENCE)
    out[sentence] = SENTENCE_CUT
    line = is_(left, _LINE)
    out[line] = LINE_CUT
    out[line & is_(left2, _LINE) & ~is_(right, _LINE)] = PARAGRAPH_CUT
    return out


class StrongestCut:
    """Sparse table: the place of the largest strength in a window, the rightmost of equals."""

    def __init__(self, strength: np.ndarray, longest: int):
        self.n = len(strength)
        levels = [strength * np.int64(self.n + 1) + np.arange(self.n)]
        span = 1
        while 2 * span <= min(longest, self.n):
            levels.append(np.maximum(levels[-1][:-span], levels[-1][span:]))
            span *= 2
        self.levels = levels

    def query(self, first: int, last: int) -> tuple[int, int]:
        """(place, strength) of the strongest from `first` to `last`, both included."""
        level = (last - first + 1).bit_length() - 1
        best = max(int(self.levels[level][first]), int(self.levels[level][last - (1 << level) + 1]))
        return best % (self.n + 1), best // (self.n + 1)


def cut(text: str, ids: np.ndarray, widths: np.ndarray, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, tokens, strength) of the pieces, begin and end in characters. widths: bytes of each token of the vocabulary."""
    n = len(ids)
    if n <= most:
        return [(0, len(text), n, PARAGRAPH_CUT)]
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(widths[ids])  # in bytes
    heads = (raw & 0xC0) != 0x80
    char_at = np.r_[0, np.cumsum(heads)][np.r_[0, ends]]  # characters that begin before each place between tokens
    whole = np.r_[heads, True][np.r_[0, ends]]
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    strength = np.full(n + 1, NO_CUT, np.int64)
    inner = np.flatnonzero(whole[1:-1]) + 1
    strength[inner] = strengths(chars, char_at[inner])
    strength[n] = PARAGRAPH_CUT
    strength += 1  # the table wants no negative values
    table = StrongestCut(strength, most)
    pieces, start = [], 0
    while n - start > most:
        least, middle = start + overlap + 1, start + max(overlap + 1, most // 2)
        end, s = table.query(middle, start + most)
        if s - 1 <= WORD_CUT and least < middle:
            early, stronger = table.query(least, middle - 1)
            if stronger > s:
                end, s = early, stronger
        if s == 0:  # one character of more tokens than the window has
            end = start + most
            while end < n and not whole[end]:
                end += 1
        pieces.append((int(char_at[start]), int(char_at[end]), end - start, s - 1))
        back = end - overlap
        while back > start + 1 and not whole[back]:
            back -= 1
        start = back if whole[back] else end
    pieces.append((int(char_at[start]), len(text), n - start, PARAGRAPH_CUT))
    return pieces


def split_texts(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", group: str = "lang", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece_no, begin_char, end_char, n_tokens, cut_strength, piece): `limits` has (group, max_tokens, overlap_tokens)."""
    known = limits.where(f"max_tokens is not null and {group} is not null").groupBy(group).agg(F.min("max_tokens").cast("long").alias("most"), F.coalesce(F.max("overlap_tokens"), F.lit(0)).cast("long").alias("overlap"))
    few = known.limit(GROUPS + 1).collect()
    if len(few) <= GROUPS:
        known = F.broadcast(documents.sparkSession.createDataFrame(few, known.schema))
    wide = documents.select(key, group, text).where(f"{text} is not null").join(known, group, "left").select(key, text, "most", "overlap")
    key_type = documents.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        widths = np.zeros(enc.max_token_value + 1, np.int64)
        for token, rank in enc._mergeable_ranks.items():
            widths[rank] = len(token)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for k, t, most, overlap in zip(*[c.to_pylist() for c in part.columns]):
                    if most is not None and most < overlap + 8:
                        raise ValueError(f"{most} tokens are too few for an overlap of {overlap}")
                    ids = enc.encode_to_numpy(t, disallowed_special=())
                    for no, (b, e, n, s) in enumerate(cut(t, ids, widths, most if most is not None else len(ids), overlap or 0)):
                        rows.append((k, no, b, e, n, s, t[b:e]))
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(columns, types)], [key, "piece_no", "begin_char", "end_char", "n_tokens", "cut_strength", "piece"])

    return wide.mapInArrow(pieces, f"{key} {key_type}, piece_no int, begin_char long, end_char long, n_tokens long, cut_strength int, piece string")
