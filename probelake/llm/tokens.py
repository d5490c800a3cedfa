"""Token counts with overlap resynchronisation, and the shared encoder.

Long texts are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a boundary inside
their overlap that is proven stable: ASCII white space stands before it, both encodings start a token there, and
they agree on the tokens on either side. Where no such boundary is found the overlap is widened, and at last the
chunk itself, up to the whole rest of the text, so the result is always that of the library on the whole text.

Shorter texts are spliced from their white-space-delimited pieces in the same way, and the encodings of pieces are
kept in a bounded memo, as most of a text's pieces have been met before. A piece's last full stop or comma after a
letter or digit is a piece of its own, and Latin-1 texts are lowered first. That is exact for a tokenizer that lowers
letters, drops white space and never joins letters or digits with other signs, and whose added tokens hold no white
space and strip none; ``Encoder`` checks this from the tokenizer's own description and encodes whole texts otherwise.

Null text counts as empty, with no tokens. Repeated rows count each, equal texts alike. Very long texts are counted
whole; one without white space has no stable boundary and is encoded in one go. Empty tables give empty results. Only
the id and the text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import json
import os
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK_CHARS, OVERLAP_CHARS, AGREE = 32768, 512, 4
MEMO_ENTRIES = 900_000
LIMIT = 2048


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: the pre-tokenizer's pattern for which pieces are exact.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A full stop or comma between a letter or digit and white space or the end.
STOP = re.compile(r"(?<=[^\W_])([.,])(?=[ \n]|\Z)")


class Memo(dict):
    """Encoded pieces, in two generations of at most ``entries``: what the last one didn't use is forgotten."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.entries, self.old = entries, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: not met, or forgotten
        self[key] = value
        return value

    def learn(self, keys: list, values: list) -> None:
        if len(self) + len(keys) > self.entries:
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, values))


class Encoder:
    """ids by the ``tokenizers`` library, without added special tokens; strings of special tokens as its default has them."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = self._splits_at_space(json.loads(self.library.to_str()))
        self.memo = Memo(entries)

    @classmethod
    def at(cls, path: str, entries: int = MEMO_ENTRIES) -> Encoder:
        """One a process; a memo of another size starts anew."""
        if path not in cls._open:
            cls._open[path] = cls(path, entries)
        elif cls._open[path].memo.entries != entries:
            cls._open[path].memo = Memo(entries)
        return cls._open[path]

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        splits = [s for s in pre.get("pretokenizers", [pre]) if s.get("type") == "Split"]
        drops = any(s.get("behavior") == "Removed" and s.get("invert") and s["pattern"].get("Regex") == APART for s in splits)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        folds = [(s["type"], s.get("content")) for s in steps] == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        return drops and folds and plain

    @staticmethod
    def _lowered(text: str) -> str:
        """Lowered where that keeps every position and can't make a special token."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return text

    def _learn(self, pieces: list[str]) -> None:
        memo = self.memo
        new = [p for p in set(pieces).difference(memo.old) if p not in memo]
        for i in range(0, len(new), memo.entries):
            part = new[i : i + memo.entries]
            memo.learn(part, [struct.pack(f"<{len(e)}I", *e.ids) for e in self.library.encode_batch_fast(part, add_special_tokens=False)])

    def _joined(self, pieces: list[str]) -> list[bytes] | None:
        """Each piece's ids; None if there are more new pieces than the memo holds."""
        for _ in range(2):
            try:
                return list(map(self.memo.__getitem__, pieces))
            except KeyError:
                self._learn(pieces)
        try:
            return list(map(self.memo.__getitem__, pieces))
        except KeyError:
            return None

    def ids(self, text: str) -> bytes:
        """ids of a whole text as little-endian unsigned 32-bit integers."""
        return spliced(self, text)[0] if len(text) > CHUNK_CHARS else self.whole(text)

    def whole(self, text: str) -> bytes:
        if self.by_piece:
            found = self._joined(STOP.sub(r" \1", self._lowered(text)).replace("\n", " ").split(" "))
            if found is not None:
                return b"".join(found)
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def with_starts(self, text: str) -> tuple[list[int], list[int]]:
        """ids and the positions at which they start; by pieces, an id inside a piece has its piece's position."""
        if self.by_piece:
            pieces = self._lowered(text).replace("\n", " ").split(" ")
            ends = [bool(STOP.search(p)) for p in pieces]
            found = self._joined([q for p, end in zip(pieces, ends) for q in ((p[:-1], p[-1]) if end else (p,))])
            if found is not None:
                starts, at, rest = [], 0, iter(found)
                for p, end in zip(pieces, ends):
                    n = len(next(rest)) + (len(next(rest)) if end else 0)
                    starts += [at] * (n // 4)
                    at += len(p) + 1
                joined = b"".join(found)
                return list(struct.unpack(f"<{len(joined) // 4}I", joined)), starts
        e = self.library.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _stable(text: str, a: dict[int, int], a_ids: list[int], b: dict[int, int], b_ids: list[int], lo: int, hi: int) -> int:
    """The last position in (lo, hi) that is a proven common boundary of two encodings, or -1.

    a, b: the index of the first token that starts at a position.
    """
    for p in sorted((p for p in a.keys() & b.keys() if lo < p < hi and text[p - 1] in " \n\t\r"), reverse=True):
        i, j = a[p], b[p]
        m = min(AGREE, i, j)
        n = min(AGREE, len(a_ids) - i - 1, len(b_ids) - j - 1)  # the last token may be cut
        if m and a_ids[i - m : i] == b_ids[j - m : j] and a_ids[i : i + n] == b_ids[j : j + n]:
            return p
    return -1


def spliced(encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[bytes, int, int]:
    """ids of a long text, the number of chunks and of widenings. ``encoder`` has whole() and with_starts()."""
    out, start, n, chunks, widened, span = [], 0, len(text), 0, 0, chunk
    while True:
        end = min(n, start + span)
        if end == n:
            out.append(encoder.whole(text[start:]))
            return b"".join(out), chunks + 1, widened
        ids, starts = encoder.with_starts(text[start:end])
        at: dict[int, int] = {}
        for i, s in enumerate(starts):
            at.setdefault(start + s, i)
        width, p = overlap, -1
        while p < 0 and width <= span:
            lo = end - width
            next_ids, next_starts = encoder.with_starts(text[lo : min(n, end + width)])
            there: dict[int, int] = {}
            for i, s in enumerate(next_starts):
                there.setdefault(lo + s, i)
            p = _stable(text, at, ids, there, next_ids, lo, end)
            if p < 0:
                width, widened = 2 * width, widened + 1
        if p < 0:
            span, widened = 2 * span, widened + 1
            continue
        out.append(_packed(ids[: at[p]]))
        start, span, chunks = p, chunk, chunks + 1


def encoded(df: DataFrame, fields: str, rows, path: str) -> DataFrame:
    """mapInArrow over (id, text, ...): ``rows(encoder, batch)`` gives the columns of ``fields``."""

    def run(batches):
        encoder = Encoder.at(path)
        for batch in batches:
            yield from rows(encoder, batch)

    return df.mapInArrow(run, fields)


def count_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, n_chunks; a row for each row."""

    def rows(encoder, batch):
        counts, chunks = [], []
        for t in batch.column(2):
            t = t.as_py() or ""
            if len(t) > CHUNK_CHARS:
                ids, k, _ = spliced(encoder, t)
            else:
                ids, k = encoder.ids(t), 1
            counts.append(len(ids) // 4)
            chunks.append(k)
        n = pa.array(counts, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array([c > limit for c in counts], pa.bool_()), pa.array(chunks, pa.int64())], names=names)

    kind = df.schema[id].dataType.simpleString()
    names = [id, "n_bytes", "n_tokens", "over_limit", "n_chunks"]
    texts = df.select(F.col(id), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text))
    return encoded(texts, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long", rows, path or tokenizer_path())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
