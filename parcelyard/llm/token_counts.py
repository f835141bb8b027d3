"""Token counts by rank-synchronous array merging.

A word-level BPE with an end-of-word suffix is applied to whole batches of
pre-tokens held as ragged numpy arrays. In each round every sequence finds its
lowest-rank adjacent pair and all occurrences of that pair are merged at once;
the surviving symbols are counted. White space ends every pre-token of this
vocabulary, so a text's count is the sum over its white-space words, and each
word is merged once per worker while it stays in a bounded cache.

Null and empty texts have no tokens. Rows are kept one to one, so repeated rows
and extra columns need no rule.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words kept in a worker's cache; a full cache is emptied, results do not depend on it.
CACHE_WORDS = 400_000
_NONE = np.int64(1) << 40


class RankMerger:
    """The merging half of a BPE vocabulary file, for many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"] for t in spec.get("added_tokens", [])}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        keys, new = [], []
        for a, b in model["merges"]:
            keys.append(vocab[a] << 32 | vocab[b])
            new.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.new = keys[self.order], np.array(new, np.int64)
        names = byte_names()
        self.plain = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in names], np.int64)

    def pretokens(self, word: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        word = unicodedata.normalize("NFC", word)
        word = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        return self.pattern.findall(word)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all sequences, back to back, and how many each has. Every sequence has at least a byte."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        sym = self.plain[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[raw[ends - 1]]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        out_sym, out_seq = [], []
        while len(sym) > 1:
            rank = np.full(len(sym), _NONE)
            pair = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (seq[:-1] == seq[1:])
            rank[:-1][known] = self.order[at[known]]
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(rank, first)
            live = np.repeat(low, np.diff(np.append(first, len(sym))))
            done = live == _NONE
            hit = (rank == live) & ~done
            if not hit.any():
                break
            # in a run such as a a a, pairs overlap: the leftmost goes first, so every second one is taken
            p = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(p) != 1))
            head = p[run][np.cumsum(run) - 1]
            p = p[(p - head) % 2 == 0]
            sym[p] = self.new[rank[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            if done.any():  # finished sequences leave the arrays
                out_sym.append(sym[done])
                out_seq.append(seq[done])
                keep &= ~done
            sym, seq = sym[keep], seq[keep]
        out_sym.append(sym)
        out_seq.append(seq)
        s, q = np.concatenate(out_sym), np.concatenate(out_seq)
        order = np.argsort(q, kind="stable")
        return s[order], np.bincount(q, minlength=len(tokens))

    def count_words(self, found: list[bytes]) -> np.ndarray:
        """Tokens of each word; special strings count one each, as the library matches them before all else."""
        owner, tokens = [], []
        out = np.zeros(len(found), np.int64)
        for i, w in enumerate(found):
            s = w.decode("utf-8", "replace")
            parts = [s]
            if self.special_pattern is not None and "<|" in s:
                out[i] = len(self.special_pattern.findall(s))
                parts = self.special_pattern.split(s)
            for part in parts:
                for t in self.pretokens(part):
                    owner.append(i)
                    tokens.append(t.encode())
        for lo in range(0, len(tokens), 100_000):
            chunk = tokens[lo : lo + 100_000]
            _, n = self.merge(chunk)
            out += np.bincount(np.array(owner[lo : lo + 100_000]), weights=n, minlength=len(found)).astype(np.int64)
        return out


def byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


_cache: dict[str, dict[bytes, int]] = {}


def split_words(text: str | None) -> list[bytes]:
    """White-space words; letters A-Z are lowered at once where no special string can be meant."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw if b"<|" in raw else raw.lower()).split()


def count_batch(path: str, texts: Iterable[str | None]) -> list[int]:
    """Token counts of whole texts."""
    cache = _cache.setdefault(path, {})
    lists = [split_words(t) for t in texts]
    new = list(set(chain.from_iterable(lists)).difference(cache))
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(set(chain.from_iterable(lists)))
        cache.update(zip(new, merger(path).count_words(new).tolist(), strict=True))
    get = cache.__getitem__
    return [sum(map(get, x)) for x in lists]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, and whether there are more than ``limit``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                texts = part.column(1).to_pylist()
                n = pa.array(count_batch(path, texts), pa.int64())
                size = pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(common.tidy(run), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
