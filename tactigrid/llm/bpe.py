"""Byte-level BPE over Arrow string arrays, one call of the library per new unit of text.

A text is cut before white space that follows a non-space character. No pre-token of the
byte-level pattern reaches across such a place and its look-ahead looks only at white space,
so the parts give exactly the tokens of the whole ("safe boundary"). A task keeps the
units it has met (a bounded number) with their ids; the rest is array arithmetic.

Units of well-known characters go to a faster implementation built from the merges of the
same file; all others (rare characters, special strings, odd white space) go to the
``tokenizers`` library itself. If the file isn't plain byte-level BPE, everything does.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split pattern of byte-level BPE as the ``tokenizers`` library applies it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MOST_UNITS = 900_000
LONGEST_KEPT = 64  # characters
SEGMENT = 1 << 16  # characters of a long text that the library gets at once

_ODD = r"[\x{b}\x{c}\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TWO = r"^ |[ \n\t]{2}|\t"
_PLAIN = re.compile(r"[\n\t -~¡-¬®-ɏ‐-‧€]*", re.ASCII)
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def segments(text: str, most: int = SEGMENT) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut between a letter and a single space
    before a letter; where there is no such place within reach the part is longer."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


def _bytes_of_symbols() -> dict[str, int]:
    """The byte each printable stand-in of byte-level BPE means: bytes that print stand for
    themselves, the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.units_hold = self._plain_bpe(spec)
        self.fast = self._fast(spec) if self.units_hold else None
        if self.fast is not None:
            self.width = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)], np.int64)
        self.forget()

    def forget(self) -> None:
        """Empty the store: it has served its task, and the worker may have others to do."""
        self.code: dict[str, int] = {}
        self.n, self.used = 0, 0
        self.lens = np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)

    @staticmethod
    def _plain_bpe(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
        return not odd and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")

    @staticmethod
    def _fast(spec: dict):
        """The same merges in rank order; None unless ids are ranks."""
        import tiktoken

        model, to_byte = spec["model"], _bytes_of_symbols()
        by_id = sorted((i, t) for t, i in model["vocab"].items() if t not in {x["content"] for x in spec.get("added_tokens") or []})
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [i for i, _ in by_id] != list(range(len(by_id))) or len(by_id) != 256 + len(merges) or model.get("ignore_merges"):
            return None
        if any(t != "".join(m) for (_, t), m in zip(by_id[256:], merges, strict=True)) or any(len(t) != 1 for _, t in by_id[:256]):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(to_byte[c] for c in t): i for i, t in by_id}, special_tokens={})

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each unit and all their ids. Units that begin with white space and end without
        are encoded as one text, which safe boundaries cut again; lengths in bytes tell where."""
        counts = np.zeros(len(units), np.int64)
        if self.fast is None:
            joined, rest = [], range(len(units))
        elif _PLAIN.fullmatch("".join(units)) and all(u[:1] in " \n" and not u[-1:].isspace() for u in units):
            joined, rest = range(len(units)), []
        else:
            fine = [u[:1] in (" ", "\n") and not u[-1:].isspace() and _PLAIN.fullmatch(u) is not None for u in units]
            joined, rest = [i for i, x in enumerate(fine) if x], [i for i, x in enumerate(fine) if not x]
        text = "".join([units[i] for i in joined])
        parts = [np.array(self.fast.encode_ordinary(text), np.int32)] if joined else [np.zeros(0, np.int32)]
        if joined:
            ends = np.cumsum(self.width[parts[0]])
            mine = [units[i] for i in joined]
            long = np.fromiter(map(len, mine), np.int64, len(mine)) if text.isascii() else np.fromiter((len(u.encode()) for u in mine), np.int64, len(mine))
            upto = np.searchsorted(ends, np.cumsum(long), side="right")
            counts[joined] = np.diff(upto, prepend=0)
        slow = self._library_ids([units[i] for i in rest]) if rest else []
        if not slow:
            return counts, parts[0]
        counts[rest] = [len(x) for x in slow]
        flat = np.zeros(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        mask = np.zeros(len(flat) + 1, np.int64)
        of_rest = np.zeros(len(units), bool)
        of_rest[rest] = True
        mask = np.repeat(of_rest, counts)
        flat[~mask] = parts[0]
        for i, x in zip(rest, slow, strict=True):
            flat[at[i] : at[i] + len(x)] = x
        return counts, flat

    def _codes(self, units: list[str]) -> np.ndarray:
        """The number of each (distinct) unit in the worker's store."""
        if self.n + len(units) > MOST_UNITS and self.n:
            self.forget()
        codes = np.fromiter(map(self.code.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            fresh = [units[i] for i in missing]
            lens, flat = self._new(fresh)
            while self.n + len(lens) > len(self.lens):
                self.lens, self.starts = np.resize(self.lens, 2 * len(self.lens)), np.resize(self.starts, 2 * len(self.starts))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            at = np.arange(self.n, self.n + len(lens))
            codes[missing] = at
            self.lens[at] = lens
            self.starts[at] = self.used + np.cumsum(lens) - lens
            self.ids[self.used : self.used + len(flat)] = flat
            for u, c in zip(fresh, at.tolist(), strict=True):
                if len(u) <= LONGEST_KEPT:
                    self.code[u] = c
            self.n += len(lens)
            self.used += len(flat)
        return codes

    def _split(self, texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
        """All units of texts without doubled white space, and how many each text has."""
        marked = pc.replace_substring(texts, "\n", " \n")
        parts = pc.split_pattern(marked, " ")
        return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.StringArray, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens per text, and (if wanted) all ids one after the other."""
        n = len(texts)
        counts = np.zeros(n, np.int64)
        if self.units_hold:
            odd = pc.match_substring_regex(texts, _ODD)
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, s))
            odd = pc.or_(odd, pc.match_substring_regex(texts, _TWO)).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(n, bool)
        easy, hard = np.flatnonzero(~odd), np.flatnonzero(odd)
        slow = [[i for s in self._library_ids(segments(t) if self.units_hold else [t]) for i in s] for t in texts.take(pa.array(hard)).to_pylist()]
        counts[hard] = [len(x) for x in slow]
        codes = lens = per = None
        if len(easy):
            units, per = self._split(texts if len(easy) == n else texts.take(pa.array(easy)))
            coded = units.dictionary_encode()
            first = np.zeros(len(units), bool)
            first[(np.cumsum(per) - per)[per > 0]] = True
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # a unit keeps the space before it, but at the start of a text or after a marked line end
            names = coded.dictionary.to_pylist()
            bare = np.unique(index[first])
            spaced = self._codes([u if u[:1] == "\n" else " " + u for u in names] + [names[k] for k in bare])
            codes = spaced[: len(names)][index]
            if len(bare):
                of = np.full(len(names), -1, np.int64)
                of[bare] = spaced[len(names) :]
                codes[first] = of[index[first]]
            lens = self.lens[codes]
            empty = first & (index == (names.index("") if "" in names else -1))
            lens = np.where(empty, 0, lens)
            owner = np.repeat(np.arange(len(easy)), per)
            counts[easy] = np.bincount(owner, weights=lens, minlength=len(easy)).astype(np.int64)
        if not want_ids:
            return counts, None
        ids = np.zeros(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        if len(easy):
            # units of a text follow one another, so the target of each unit is its text's start plus what came before
            before = np.cumsum(lens) - lens
            ends = np.cumsum(per)
            base = np.where(per > 0, before[np.minimum(ends - per, len(before) - 1)], 0) if len(before) else np.zeros(len(easy), np.int64)
            target = before + np.repeat(at[easy] - base, per)
            within = np.arange(int(lens.sum())) - np.repeat(before, lens)
            found = self.ids[np.repeat(self.starts[codes], lens) + within]
            if not len(hard):
                return counts, found
            ids[np.repeat(target, lens) + within] = found
        for i, x in zip(hard, slow, strict=True):
            ids[at[i] : at[i] + len(x)] = x
        return counts, ids


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
