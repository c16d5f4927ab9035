"""Byte-pair encoding of many words at once, for tokenizers that lower-case, drop white space and end words with a suffix.

White space never joins a pre-token, so a text's ids are those of its white-space-delimited chunks. Chunks of plain letters,
digits and ASCII signs are cut into pre-tokens and merged as arrays: in each round every word finds its merge of lowest rank
and applies it, all words together. Every other chunk (an apostrophe, special tokens, other scripts), and every chunk of a
tokenizer of another make, goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: The pre-tokenizer and normalizer for which the array path is right.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_NONE = np.int32(2**31 - 1)
_LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.int8)
    out[0x21:0x7F] = _SIGN
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[ord("'")] = _OTHER
    return out


_CLASS = _classes()


def _byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = (
            (made.get("normalizer") or {}).get("normalizers") == _NORMAL and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges") and not model.get("dropout")
            and all(t["content"].startswith("<|") for t in made["added_tokens"])
        )
        if self.plain:
            vocab = model["vocab"]
            letters = _byte_symbols()
            self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
            self.last = np.array([vocab[c + "</w>"] for c in letters], dtype=np.int64)
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.width = max(vocab.values()) + 1
            keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
            self._table(keys, np.array([vocab[a + b] for a, b in pairs], dtype=np.int32))

    def _table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """A hash table with linear probing; ``slots`` gives the merge's rank."""
        bits = max(12, int(len(keys)).bit_length() + 4)
        self.shift, self.factor = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        self.keys, self.ranks = np.full((1 << bits) + 64, -1, dtype=np.int64), np.full((1 << bits) + 64, _NONE, dtype=np.int32)
        self.made, self.probes = made, 1
        at = ((keys.astype(np.uint64) * self.factor) >> self.shift).astype(np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), at.tolist(), strict=True)):
            k = slot
            while self.keys[k] != -1 and self.keys[k] != key:
                k += 1
            if self.keys[k] == -1:
                self.keys[k], self.ranks[k] = key, rank
                self.probes = max(self.probes, k - slot + 1)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        slot = ((key.astype(np.uint64) * self.factor) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NONE)
        for k in range(1, self.probes):
            more = self.keys[slot + k] == key
            if more.any():
                out[more] = self.ranks[slot[more] + k]
        return out

    def _merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and the words they belong to (in order) after all merges."""
        done_s, done_w = [], []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            rank = np.full(len(symbol), _NONE, dtype=np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self._rank(symbol[inside] * self.width + symbol[inside + 1])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbol)))
            least = np.repeat(least, sizes)
            over = least == _NONE
            done_s.append(symbol[over])
            done_w.append(word[over])
            hit = np.flatnonzero((rank == least) & ~over)
            if not len(hit):
                break
            run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))  # of a pair of equal symbols in a row, every other one merges
            start = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
            hit = hit[((hit - start) & 1) == 0]
            symbol = symbol.copy()
            symbol[hit] = self.made[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    def _plain_ids(self, chunks: list[bytes]) -> list[bytes | None]:
        """Ids of the chunks that the array path can encode; None for the others."""
        data = np.frombuffer(b"".join(chunks), dtype=np.uint8).copy()
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        kind = _CLASS[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (chunk[1:] == chunk[:-1]))
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[(data[lead + 1] <= 0x9E)] + 1
        data[upper] += 0x20
        ascii_upper = (data >= 0x41) & (data <= 0x5A)
        data[ascii_upper] += 0x20
        bad = np.zeros(len(chunks), dtype=bool)
        bad[chunk[kind == _OTHER]] = True
        bad[chunk[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)]] = True
        ok = ~bad[chunk]
        data, chunk, kind = data[ok], chunk[ok], kind[ok]
        out: list[bytes | None] = [None] * len(chunks)
        if not len(data):
            return out
        begins = np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)))
        ends = np.append(begins[1:], True)
        symbol = np.where(ends, self.last[data], self.inner[data])
        word = np.cumsum(begins) - 1
        of_word = chunk[begins]
        symbol, word = self._merge(symbol, word)
        ids = symbol.astype("<u4").tobytes()
        bounds = 4 * np.searchsorted(of_word[word], np.arange(len(chunks) + 1))
        bounds = bounds.tolist()
        for k in np.flatnonzero(~bad).tolist():
            out[k] = ids[bounds[k] : bounds[k + 1]]
        return out

    def encode_chunks(self, chunks: list[bytes]) -> None:
        """Make the ids of these distinct chunks known."""
        found: list[bytes | None] = self._plain_ids(chunks) if self.plain else [None] * len(chunks)
        rest = [k for k, x in enumerate(found) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([chunks[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            found[k] = np.asarray(e.ids, dtype="<u4").tobytes()
        self.known.update(zip(chunks, found, strict=True))

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > self.cache_words:
            known.clear()
        # the tokenizer lower-cases anyway; a text that may hold a special token keeps its case, which tells the token
        split = [(t.lower() if self.plain and b"<|" not in t else t).split() for t in texts]
        rows = [list(map(known.get, x)) for x in split]
        new = {w for x, r in zip(split, rows, strict=True) for w, i in zip(x, r, strict=True) if i is None}
        if new:
            self.encode_chunks(list(new))
            rows = [[known[w] if i is None else i for w, i in zip(x, r, strict=True)] for x, r in zip(split, rows, strict=True)]
        return [b"".join(r) for r in rows]
