"""Fill-in-middle transformation by rank and select over packed token boundaries (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes whose boundary bits are found at once; a multiple of BLOCK.
PIECE = 1 << 20
#: Bytes of text, and so bits, of which the directory has one count.
BLOCK = 512

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Boundaries:
    """A bit for each byte of a text, 1 where a token begins, and how many ones stand before each block of :data:`BLOCK` bits.

    Tokens are runs of A-Z and a-z, and any other code point alone. The bits take an eighth of the text and the directory an
    eighth of the bits; nothing grows with the number of tokens.
    """

    def __init__(self, text: bytes):
        self.size = len(text)
        source = np.frombuffer(text, dtype=np.uint8)
        self.words = np.zeros(-(-max(1, self.size) // BLOCK) * (BLOCK // 64), dtype="<u8")
        bits = self.words.view(np.uint8)
        before = False
        for at in range(0, self.size, PIECE):
            part = source[at : at + PIECE]
            letter = _LETTER[part]
            begins = (part & 0xC0) != 0x80
            begins[1:] &= ~(letter[1:] & letter[:-1])
            begins[0] &= not (letter[0] and before)
            before = bool(letter[-1])
            packed = np.packbits(begins, bitorder="little")
            bits[at // 8 : at // 8 + len(packed)] = packed
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    @property
    def total(self) -> int:
        """The number of tokens."""
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The byte at which token ``rank`` begins, from 0; the size of the text for the rank behind the last."""
        if rank >= self.total:
            return self.size
        block = int(np.searchsorted(self.before, rank, side="right")) - 1
        left = rank - int(self.before[block])
        for i in range(block * (BLOCK // 64), (block + 1) * (BLOCK // 64)):
            word = int(self.words[i])
            ones = word.bit_count()
            if left < ones:
                for _ in range(left):
                    word &= word - 1
                return i * 64 + (word & -word).bit_length() - 1
            left -= ones
        raise AssertionError("the directory counts more bits than there are")


def _chars(text: np.ndarray) -> int:
    return sum(int(np.count_nonzero((text[i : i + PIECE] & 0xC0) != 0x80)) for i in range(0, len(text), PIECE))


def cuts(text: bytes, first: int, second: int) -> tuple[int, int, int, int, int]:
    """Tokens, the bytes at which prefix and middle end, and the code points of both; the ends are ``first`` and ``second`` modulo the tokens and one."""
    found = Boundaries(text)
    low, high = sorted((first % (found.total + 1), second % (found.total + 1)))
    a, b = found.select(low), found.select(high)
    source = np.frombuffer(text, dtype=np.uint8)
    return found.total, a, b, _chars(source[:a]), _chars(source[a:b])


_CUTS = ["n", "_a", "_b", "prefix_chars", "middle_chars"]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, first, second = (batch.column(i) for i in range(3))
        rows = [cuts(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(text, first, second, strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(_CUTS)
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], text, *[pa.array(c, type=pa.int64()) for c in columns]], names=[*batch.schema.names[3:], "_text", *_CUTS])


def _draw(doc_id: Column, group: int, seed: int) -> Column:
    """Eight hexadecimal digits of the digest of seed and id, as an unsigned number; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, text, output`` for every row of ``documents``.

    Two ranks from a digest of seed and id cut the text between tokens into prefix, middle and suffix. ``form`` is psm, spm (``spm`` of 100) or plain:
    ``plain`` of 100, and every text that is empty or holds a mark, whose output would not tell where its parts begin. A null text is
    an empty one, a null doc_id draws as an empty id, repeated rows give equal rows, an empty table gives an empty result, and columns other than ``doc_id``
    and ``text`` are not read. The parts are cut from the bytes, so that any text comes back exactly.
    """
    small_batches(documents.sparkSession)
    h = [_draw(F.col("doc_id"), i, seed) for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= text.contains(mark)
    form = F.when((text == "") | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    given = documents.select(text.cast("binary").alias("_text"), h[0].alias("_h1"), h[1].alias("_h2"), "doc_id", form.alias("form"))
    kind = given.select("doc_id").schema.simpleString()[7:-1]
    cut = given.mapInArrow(_run, f"{kind}, form string, _text binary, n bigint, _a bigint, _b bigint, prefix_chars bigint, middle_chars bigint")
    whole, a, b = F.col("_text"), F.col("_a").cast("int"), F.col("_b").cast("int")
    first, middle, last = F.substr(whole, F.lit(1), a), F.substr(whole, a + 1, b - a), F.substr(whole, b + 1)
    p, s, m = (F.lit(x.encode()) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(p, first, s, last, m, middle)).otherwise(F.concat(s, last, p, first, m, middle))
    chars = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return cut.select("doc_id", "n", "form", *chars, whole.cast("string").alias("text"), output.cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of which ``output`` was made: its parts stand between the marks, of which the text has none."""

    def between(start: str, end: str | None) -> Column:
        from_ = F.instr(output, start) + len(start)
        return F.substr(output, from_) if end is None else F.substr(output, from_, F.instr(output, end) - from_)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
