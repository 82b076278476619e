"""Quality rules, with tokenizer fertility by public vocabularies.

Base rules count what a text is made of: words, symbols, repeated lines and repeated word windows.
Beyond them, a text is cut into tokens by two public vocabularies and measured:

* ``chars_per_token``: code points of its words per token of the byte-level vocabulary. Text of
  a kind that the vocabulary was not made for, or no text at all, falls into many short tokens.
* ``fallback_share``: share of the byte tokens among the tokens of the piece vocabulary, which
  falls back on bytes for characters that it does not know.
* ``token_entropy``: entropy of the byte-level tokens in bits, over the largest that so many
  tokens can have (log2 of their number); a low value means that few tokens come again and again.

Each measure has a band per language, or per script where a text has no language: a text outside
is rejected. Bands come from all texts that pass the base rules: quartiles, widened by
``reach`` times their distance, but never narrower than ``margin`` around them. Each end has a reach
of its own, or none and is open: few characters per token are what junk has, many are hardly ever
wrong. The reaches are as narrow as a budget of 2 % of the good texts lets them be. Languages with fewer than
``least_rows`` such texts get the bands of all texts.

Words are encoded one by one, with a space before, and each distinct word of a batch once; a
worker remembers a bounded number of words.

Edge cases: null and empty texts have no words, fail the base rules and are not kept; their measures
are null. Lines without a word never count as repeated. Rows with null or repeated ids are judged like
others. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrace.llm import words as W
from sumtrace.llm.common import arrow_batches
from sumtrace.session import cut

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent
#: Reach of a band's lower and upper end in distances of the quartiles, by measure; None: open.
REACH = {"chars_per_token": (2.0, 5.0), "fallback_share": (None, 5.0), "token_entropy": (1.5, None)}
LEAST_ROWS = 100
REMEMBERED = 200_000
#: Least distance of a band's ends from the quartiles, by measure.
MARGIN = {"chars_per_token": 0.05, "fallback_share": 0.05, "token_entropy": 0.15}
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80  # of a character
_PIECE = 1 << 19


class Vocabularies(NamedTuple):
    """Files: ranks of a byte-level vocabulary, and a piece vocabulary with byte fallback."""

    ranks: str
    pieces: str


def default_vocabularies() -> Vocabularies:
    import public_tokenizers

    return Vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


@cache
def _encoders(files: Vocabularies):
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(files.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    byte_level = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    return byte_level, pieces, is_byte, {}


def _encoded(words: list[str], hashes: list[int], files: Vocabularies) -> list[tuple[bytes, int, int]]:
    """For each word: ids by the byte-level vocabulary, number of pieces, number of byte pieces."""
    byte_level, pieces, is_byte, memory = _encoders(files)
    new = [i for i, h in enumerate(hashes) if h not in memory]
    if len(memory) + len(new) > REMEMBERED:
        memory.clear()
        new = list(range(len(hashes)))
    of_pieces = pieces.encode([words[i] for i in new], num_threads=1)
    for i, own in zip(new, of_pieces):
        ids = np.array(byte_level.encode_ordinary(" " + words[i]), np.int32)
        memory[hashes[i]] = (ids.tobytes(), len(own), int(is_byte[own].sum()) if own else 0)
    return [memory[h] for h in hashes]


def _repeated_words(words: W.Words, h: np.ndarray) -> np.ndarray:
    """Per text: words in windows that occur more than once in it."""
    n = len(words.first) - 1
    run, at = W.runs(words, h, WINDOW)
    key = W.mixed(run + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = at[order[np.r_[same, False] | np.r_[False, same]]] if len(at) else at
    change = np.zeros(len(h) + 1, np.int32)
    change[again] += 1
    np.add.at(change, again + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(words.text[covered], minlength=n)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = W.split(data, offsets, newline)
    if not len(lines.start):
        return np.zeros(n, np.int64)
    h = W.hashed(lines)
    solid = np.add.reduceat(~W.SEPARATOR[data[lines.start[0] :]], lines.start - lines.start[0]) > 0
    # a sum from one line's first byte to the next line's also spans line feeds, which are separators
    h, text = h[solid], lines.text[solid]
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][same], minlength=n)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.int64), first[:-1][full])
    return out


def measured_piece(data: np.ndarray, offsets: np.ndarray, files: Vocabularies) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words = W.split(data, offsets)
    h = W.hashed(words)
    count = words.count
    chars = np.concatenate([[0], np.cumsum(_FIRST_BYTE[data])])
    out = {
        "n_words": count.astype(np.int64),
        "word_chars": _sums(chars[words.end] - chars[words.start], words.first),
        "n_symbols": _sums(_IS_SYMBOL[data], offsets),
        "n_dup_lines": _repeated_lines(data, offsets, n).astype(np.int64),
        "n_repeat_words": _repeated_words(words, h).astype(np.int64),
    }
    distinct, where, of = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[where].tolist(), words.end[where].tolist())]
    known = _encoded(texts, distinct.tolist(), files)
    flat = np.frombuffer(b"".join([k[0] for k in known]), np.int32)
    size = np.array([len(k[0]) // 4 for k in known], np.int64)
    n_pieces, n_bytes = (np.array([k[i] for k in known], np.int64) for i in (1, 2))
    tokens = size[of]
    begin = np.cumsum(tokens) - tokens
    total = int(tokens.sum())
    at = np.arange(total) - np.repeat(begin, tokens) + np.repeat((np.cumsum(size) - size)[of], tokens)
    key = np.repeat(words.text, tokens) << 20 | flat[at]
    kinds, times = np.unique(key, return_counts=True)
    n_tokens = _sums(tokens, words.first)
    share = times / n_tokens[kinds >> 20]
    entropy = np.bincount(kinds >> 20, weights=-share * np.log2(share), minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["chars_per_token"] = out["word_chars"] / n_tokens
        out["fallback_share"] = _sums(n_bytes[of], words.first) / _sums(n_pieces[of], words.first)
        out["token_entropy"] = np.where(n_tokens > 1, entropy / np.log2(np.maximum(n_tokens, 2)), 1.0)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, files: Vocabularies | None = None) -> DataFrame:
    """Base counts and measures of every row: doc_id, lang, script, the counts, the measures."""
    files = files or default_vocabularies()
    arrow_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    # the script is told from the first letter beyond Latin, if any
    script = (
        F.when(text.rlike(r"\p{IsCyrillic}"), "Cyrillic")
        .when(text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"), "East Asian")
        .when(text.rlike(r"[\p{IsArabic}\p{IsHebrew}]"), "Semitic")
        .otherwise("Latin")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.when(lang.isNull(), script)).alias("band"), text.alias("text"))

    def of(batches):
        for batch in batches:
            for piece, data, offsets in W.pieces(batch, size=_PIECE):
                got = measured_piece(data, offsets, files)
                columns = [pa.array(got[c], pa.int64()) for c in _COUNTS]
                columns += [pa.array(got[c], pa.float64(), mask=got["n_words"] == 0) for c in MARGIN]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], names=["doc_id", "band", *_COUNTS, *MARGIN])

    schema = "doc_id long, band string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in MARGIN)
    return rows.mapInArrow(of, schema)


def bands(passing: DataFrame, reach: dict[str, tuple[float | None, float | None]] = REACH, least_rows: int = LEAST_ROWS) -> dict[str | None, dict[str, tuple[float, float]]]:
    """Band of each measure by language; under None, of all rows."""
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(c) for c in MARGIN]
    rows = passing.groupBy("band").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= least_rows).collect()
    rows += passing.agg(F.lit(None).cast("string").alias("band"), F.count("*").alias("n"), *quartiles).where("n > 0").collect()
    out = {}
    for row in rows:
        own = {}
        for c, margin in MARGIN.items():
            low, high = row[c]
            down, up = (None if r is None else max(r * (high - low), margin) for r in reach[c])
            own[c] = (-math.inf if down is None else low - down, math.inf if up is None else high + up)
        out[row["band"]] = own
    return out


def judged(docs: DataFrame, files: Vocabularies | None = None, reach: dict[str, tuple[float | None, float | None]] = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(doc_id, counts, base_failed, kept, measures) of every row."""
    table = cut(measured(docs, files))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    table = table.withColumn("base_failed", failed)
    limits = bands(table.where(~failed), reach, least_rows)
    fits = F.lit(True)
    common = limits.get(None)
    for c in MARGIN if common else ():
        inside = F.col(c).between(*common[c])
        for name, own in limits.items():
            if name is not None:
                inside = F.when(F.col("band") == name, F.col(c).between(*own[c])).otherwise(inside)
        fits = fits & inside
    kept = ~F.col("base_failed") & F.coalesce(fits, F.lit(False))
    return table.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), *MARGIN)
