"""SentencePiece encoding and decoding with a prefix table (operator 3) and count-only Viterbi (operator 6).

Encoding.  Of a merge-type vocabulary every prefix of a text has one last
token.  The table stores it: at each place the Aho-Corasick automaton gives
the pieces that end there, and the one that is compatible with the last
token of the prefix before it - merging the two pieces' characters gives
just the two - is entered.  The ids are then read backwards, and decoding
reads the text from the ids.  No piece
crosses from other characters to a word mark, and characters outside the
vocabulary stand alone, so the table is built for each marked word and kept
for words that come again.

Counting.  With the pieces read as a unigram vocabulary, dynamic programming
over the automaton's matches carries the best score and its piece count; an
end keeps the first best start, as the tokenizer does, so that of equal
scores the longest last piece wins.  Characters outside the vocabulary cost
``min score - 10`` and count one token for each of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import re
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import held, trim

MARK = "▁"
#: Words that each of a worker's two generations keeps, and the longest of them.
KEPT, KEPT_CHARS = 120_000, 64
UNKNOWN_PENALTY = 10.0
STAND_ALONE = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces, scores and automaton of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        byte_ids = {self.text[i]: i for i in range(n) if model.is_byte(i)}
        self.byte = [byte_ids.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.byte:
            raise ValueError("the model has no byte fallback")
        self.of_byte = {i: b for b, i in enumerate(self.byte)}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark inside")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))
        self.words = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+")
        self.unusual = re.compile(f"^ |  |{MARK}|[{alone}]".replace("\n", "")).search
        self.fast = "\n" in alone
        self.chars = {c for c in self.id if len(c) == 1}
        self.raw = [int(i).to_bytes(4, "little") for i in range(n)]
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        #: What an id says, word marks as spaces; None for a byte's.
        self.say = [None if i in self.of_byte else "" if i in (self.bos, self.eos) else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        #: The packed ids of words, and what these ids say.
        self._kept: dict[str, tuple[bytes, str]] = {"": (b"", "")}
        self._older: dict[str, tuple[bytes, str]] = {}
        self._counts: dict[str, int] = {"": 0}
        self._older_counts: dict[str, int] = {}
        self.lowest = min(self.score[i] for i in normal) - UNKNOWN_PENALTY

    # encoding

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay what they are side by side."""
        a, b = self.text[left], self.text[right]
        return self.merged(a + b) == [a, b]

    def whole(self, i: int) -> bool:
        """Whether merging the piece's characters gives the piece."""
        found = self._whole.get(i)
        if found is None:
            found = self._whole[i] = self.merged(self.text[i]) == [self.text[i]]
        return found

    def _fits(self, before: int, i: int) -> bool:
        """Whether piece ``i`` may follow the last token ``before`` of the prefix in front of it."""
        key = before << 32 | i
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            found = self._pairs[key] = self.whole(i) and (before == STAND_ALONE or self.compatible(before, i))
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one marked word, through the table of its prefixes' last tokens."""
        n = len(word)
        last: list[int | None] = [None] * n
        size = [1] * n
        if not self.chars.issuperset(word):
            last = [None if c in self.chars else STAND_ALONE for c in word]
        known, fits = self._pairs.get, self._fits
        for end, (length, i) in self.automaton.iter(word):
            if last[end] is None:
                start = end - length
                before = last[start] if start >= 0 else STAND_ALONE
                if before is not None:
                    ok = known(before << 32 | i)
                    if ok or ok is None and fits(before, i):
                        last[end], size[end] = i, length
        ids: list[int] = []
        end = n - 1
        while end >= 0:
            i = last[end]
            if i is None:  # no token of the table ends here: merge plainly
                return self.plain(word)
            if i == STAND_ALONE:
                ids.extend(self.byte[b] for b in reversed(word[end].encode()))
            else:
                ids.append(i)
            end -= size[end]
        ids.reverse()
        return ids

    def plain(self, word: str) -> list[int]:
        """Ids of one marked word by plain merging."""
        out: list[int] = []
        for part in self.merged(word):
            i = self.id.get(part)
            out += [i] if i is not None else [self.byte[b] for b in part.encode()]
        return out

    def marked_words(self, text: str) -> list[str]:
        """The text with its word marks, cut where no piece can cross; empty strings may stand between."""
        if not text:
            return []
        if self.fast and not self.unusual(text):
            if "\n" not in text:
                return (MARK + text.replace(" ", " " + MARK)).split(" ")
            return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        return self.words.findall(MARK + text.replace(" ", MARK))

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        found = b"".join([self.raw[i] for i in ids]), self.spelled(ids)
        if len(word) <= KEPT_CHARS:
            if len(self._kept) >= KEPT:
                self._older, self._kept = self._kept, {"": (b"", "")}
            self._kept[word] = found
        return found

    def _again(self, word: str) -> tuple[bytes, str]:
        found = self._older.get(word)
        if found is None:
            return self._word(word)
        self._kept[word] = found
        return found

    def spelled(self, ids: list[int]) -> str:
        """What ids say, word marks as spaces; bytes that are no UTF-8 are replaced."""
        said = [self.say[i] for i in ids]
        if None not in said:
            return "".join(said)
        return b"".join([bytes([self.of_byte[i]]) if t is None else t.encode() for i, t in zip(ids, said, strict=True)]).decode("utf-8", "replace")

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """``(ids, decoded)``: ids with begin and end as little-endian unsigned 32-bit numbers, and the text read from them."""
        words = self.marked_words(text or "")
        get = self._kept.get
        parts = [get(w) for w in words]
        if None in parts:
            parts = [self._again(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join([self.raw[self.bos], *[p[0] for p in parts], self.raw[self.eos]]), "".join([p[1] for p in parts])[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; the space that encoding put in front goes."""
        said = self.spelled(ids)
        return said[1:] if said.startswith(" ") else said

    # counting

    def count_word(self, word: str) -> int:
        """Pieces on the best path through one marked word."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        at, score, whole = 0, self.score, self.chars.issuperset(word)

        def alone(end: int) -> None:
            """A character outside the vocabulary; one inside it has a piece, so that nothing is lost by that."""
            if word[end] not in self.chars and best[end] is not None:
                got = best[end] + self.lowest
                if best[end + 1] is None or got > best[end + 1]:
                    best[end + 1], count[end + 1] = got, count[end] + len(word[end].encode())

        for end, (length, i) in self.automaton.iter(word):  # at one end the longest first: it stays on a tie
            if not whole:
                while at < end:
                    alone(at)
                    at += 1
            was = best[end - length + 1]
            if was is not None:
                got = was + score[i]
                if best[end + 1] is None or got > best[end + 1]:
                    best[end + 1], count[end + 1] = got, count[end - length + 1] + 1
        if not whole:
            for end in range(at, n):
                alone(end)
        return count[n]

    def count(self, text: str | None) -> int:
        """Unigram tokens of a text, without begin and end."""
        words = self.marked_words(text or "")
        get = self._counts.get
        found = [get(w) for w in words]
        if None in found:
            for k, n in enumerate(found):
                if n is None:
                    word = words[k]
                    n = self._older_counts.get(word)
                    found[k] = n = self.count_word(word) if n is None else n
                    if len(word) <= KEPT_CHARS:
                        if len(self._counts) >= KEPT:
                            self._older_counts, self._counts = self._counts, {"": 0}
                        self._counts[word] = n
        return sum(found)


def pieces_of(path: str) -> Pieces:
    """The worker's table of a model."""
    return held(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, outputs: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])`` for each row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit numbers with begin and end
    tokens; a null text is taken as empty.  ``decoded`` is read from the ids,
    word by word.  A very long text is encoded whole, also as one word; of
    equal merges the leftmost goes first.  Repeated rows and null ids keep
    their rows, an empty table has none.  ``model`` is a path that every
    executor has.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [table.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                     pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                     pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string()),
                     *([pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())] if outputs else [])],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if outputs else [])],
                )
        trim()

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id, n_tokens)`` for each row of ``docs``: unigram tokens; 0 for a null or empty text.

    Of paths of one score the one whose last piece is longest counts.  A very
    long text is counted whole; repeated rows and null ids keep their rows.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([table.count(t) for t in part.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"]
                )
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_tokens long"
    )


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Query: every document encoded and decoded."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=False)
    return found.withColumnRenamed("id", "doc_id")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: unigram token counts of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
