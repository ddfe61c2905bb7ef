"""Token ids of many texts: a part of a text is encoded once and its ids are kept.

Both public tokenizer files treat the sides of a single space or line break, and the letters and
the marks of a word, on their own. Texts are cut there by Arrow, and their ids are put together
from those of the distinct parts; a text with irregular white space goes through the tokenizer
whole. Either way the ids are those of the tokenizer for the whole text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newsloom.llm.common import listed

KEPT_PARTS = 700_000
SLICE = 1 << 20  # characters

_WHITE = ("\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
          "\\x{205f}\\x{3000}")
_IRREGULAR = f"[{_WHITE}][{_WHITE}]|^[{_WHITE}]|[{_WHITE}]$|\\x01"
# Letters whose class, case and normal form all versions of Unicode agree on.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKED = f"([{_LETTERS}])([.,;:!?]+)(\\s|$)"


class WordEncoder:
    """Ids by a ``tokenizers`` file, as unsigned 32-bit numbers.

    Special tokens are never added. The string of an added token in a text gives that token's id
    if ``added``, as the library has it, and is ordinary text otherwise; texts with such a string,
    in any case, go through the tokenizer whole.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(map(re.escape, strings)) if added else ""
        names = [self.tokenizer.id_to_token(i) or ""
                 for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = self.tokenizer.normalizer is None  # a space belongs to the word after it
        self.first = np.array([n.startswith("Ġ") for n in names])
        self.last = np.array([n.endswith("</w>") for n in names])
        # Parts and their ids: as Arrow arrays they take a fifth of a dict's memory.
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's own records of a text are far larger than its ids: a few at a time."""
        return [np.array(e.ids, "<u4").tobytes() for k in range(0, len(texts), 64)
                for e in self.tokenizer.encode_batch_fast(texts[k:k + 64], add_special_tokens=False)]

    def _letters(self, words: list[str]) -> pa.Array:
        """Ids of words of letters (after a space, if it counts), cut out of one long text."""
        ids = np.array(self.tokenizer.encode_batch_fast(
            ["".join(words) if self.spaced else " ".join(words)],
            add_special_tokens=False)[0].ids, "<u4")
        if self.spaced:
            cuts = np.append(np.flatnonzero(self.first[ids]), len(ids))
        else:
            cuts = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        if len(cuts) != len(words) + 1:
            raise ValueError("the tokenizer does not treat words on their own")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [
            None, pa.py_buffer(cuts.astype(np.int64) * 4), pa.py_buffer(ids)])

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Keep the ids of new parts; where each has its place among the parts kept."""
        wanted = f"^ [{_LETTERS}]+$" if self.spaced else f"^ ?[{_LETTERS}]+$"
        plain = pc.match_substring_regex(new, wanted)
        letters, odd = new.filter(plain), new.filter(pc.invert(plain))
        places, first = np.empty(len(new), np.int64), len(self.words)
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        places[order] = np.arange(first, first + len(new))
        ids = [self.ids]
        for k in range(0, len(letters), 8192):
            words = listed(letters.slice(k, 8192))
            ids.append(self._letters(words if self.spaced else [w.strip() for w in words]))
        if len(odd):
            ids.append(pa.array(self._whole(listed(odd)), pa.large_binary()))
        self.words, self.ids = pa.concat_arrays([self.words, letters, odd]), pa.concat_arrays(ids)
        return places

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct parts have their ids among those kept; new ones are learnt."""
        found = pc.index_in(parts, value_set=self.words)
        new = found.is_null()
        places = found.fill_null(0).to_numpy().astype(np.int64)
        unknown = new.to_numpy(zero_copy_only=False)
        if len(self.words) + int(unknown.sum()) > KEPT_PARTS:  # only those just found stay
            used = pa.array(places[~unknown])
            self.words, self.ids = self.words.take(used), self.ids.take(used)
            places[~unknown] = np.arange(len(used))
        if unknown.any():
            places[unknown] = self._learn(parts.filter(new))
        return places

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Which texts go through the tokenizer whole; the parts of the others, where each begins."""
        odd = pc.match_substring_regex(column, _IRREGULAR).to_numpy(zero_copy_only=False)
        if self.added:
            odd = odd | pc.match_substring_regex(column, self.added, ignore_case=True).to_numpy(
                zero_copy_only=False)
        cut = pc.if_else(pa.array(odd), "", column)
        cut = pc.replace_substring_regex(cut, _MARKED, "\\1\x01\\2\\3")
        cut = pc.replace_substring(cut, " ", "\x01 ")
        cut = pc.replace_substring(cut, "\n", "\x01\n\x01")
        lists = pc.split_pattern(cut, "\x01")
        return odd, lists.flatten(), lists.offsets.to_numpy()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each begins (one more); null: none.

        Texts are cut and put together about ``SLICE`` characters at a time, so that copies of
        them stay small; their distinct parts are looked up once for all.
        """
        ends = np.cumsum([len(t or "") for t in texts])
        edges = np.flatnonzero(np.diff(ends // SLICE, prepend=0)).tolist()
        slices = [texts[a:b] for a, b in zip([0, *edges], [*edges, len(texts)]) if a < b]
        cuts = [self._cut(pa.array([t or "" for t in part], pa.large_string())) for part in slices]
        coded = pa.chunked_array([c[1] for c in cuts], pa.large_string()).dictionary_encode()
        cuts = [(odd, at) for odd, _, at in cuts]
        places = self._places(coded.chunk(0).dictionary) if slices else np.empty(0, np.int64)
        indices = [c.indices.to_numpy() for c in coded.chunks]
        del coded
        out, starts, total = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], 0
        for part, (odd, at), chosen in zip(slices, cuts, indices):
            taken = self.ids.take(pa.array(places[chosen]))
            _, offsets, store = taken.buffers()
            ends = np.frombuffer(offsets, np.int64, len(taken) + 1)
            ids = np.frombuffer(store, "<u4", ends[-1] // 4) if ends[-1] else np.empty(0, "<u4")
            begins = ends[at] // 4
            if odd.any():
                whole = np.flatnonzero(odd)
                parts = np.split(ids, begins[1:-1])
                for i, raw in zip(whole, self._whole([part[i] for i in whole])):
                    parts[i] = np.frombuffer(raw, "<u4")
                ids = np.concatenate(parts)
                begins = np.append(0, np.cumsum([len(p) for p in parts]))
            out.append(ids)
            starts.append(begins[1:] + total)
            total += len(ids)
        return np.concatenate(out), np.concatenate(starts)


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> WordEncoder:
    """One encoder for each file, way with added tokens and Python process."""
    return WordEncoder(path, added)
