"""Token ids of whole texts with a public tokenizer file, for use inside Spark tasks.

White space ends a token in both supported kinds of vocabulary, so a text is cut into units that the
tokenizer treats alike wherever they stand. Arrow splits a slice of texts and finds its distinct units;
each is encoded once per worker, and the ids of the texts are gathered from that store. Texts with white
space for which this is not certain, or with the string of a special token, are encoded in one piece.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNITS_KEPT = 600_000  # units in a worker's store before it is reduced to those in use; changes speed only
#: Characters that not every library takes for white space alike, as a character class of RE2.
UNSURE = r"\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A unit of letters with at most one mark after it is the tokens of the letters and those of the mark (zero: a text's first unit).
MARKED = r"^(?P<zero>\x00?)(?P<line>\n?)(?P<word>\p{L}+)(?P<mark>[.,;:!?]?)$"
JOINED = 64  # letter units that are encoded as one text, with a mark between them


def _strings(array: pa.Array) -> list[str]:
    """An array's strings, converted all at once rather than scalar by scalar."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``encode(texts)`` gives one flat uint32 array and the number of ids of each text.

    A vocabulary whose normalizer drops white space has words as units. Otherwise a unit stands for itself
    with a blank before it, except after a line break, and except the first of a text, marked by a zero.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words = self.tokenizer.normalizer is not None
        # letters alone are one pre-token, so they need no splitting but at the marks that join them
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("!", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark,) = self.letters.encode("!", add_special_tokens=False).ids
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.unsure = (f"[{UNSURE}]" if self.words else rf"[ \n][ \n]|[\t\v\f\r{UNSURE}]") + (f"|(?i:{added})" if added else "")
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _unit_text(self, unit: str) -> str:
        if self.words or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == "\x00" else " " + unit

    def _letters(self, unit: str) -> bool:
        """Whether a unit of letters beyond ASCII is letters here too, and stays so when the normalizer puts it in lower case."""
        return unit.isalpha() and (not self.words or unicodedata.normalize("NFC", unit).lower().isalpha())

    def _append(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m, total = len(self.index), len(units), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used:self.used + total] = ids
        self.starts[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.lengths[n:n + m] = sizes
        self.used += total
        self.index.update(zip(units, range(n, n + m), strict=True))

    def _encode_units(self, units: list[str]) -> None:
        if units:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([self._unit_text(u) for u in units], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self._append(units, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes)

    def _encode_letters(self, units: list[str]) -> None:
        """Many at once: no letters have the token of the mark that joins them."""
        if units:
            blank = "" if self.words else " "
            texts = [blank + f"!{blank}".join(units[i:i + JOINED]) + "!" for i in range(0, len(units), JOINED)]
            parts = (self.letters.encode_batch_fast(texts[i:i + JOINED], add_special_tokens=False) for i in range(0, len(texts), JOINED))
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for part in parts for e in part])
            ends = ids == self.mark
            self._append(units, ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1)

    def _places(self, units: list[str]) -> np.ndarray:
        """Where units are stored; -1 for new ones."""
        return np.fromiter(map(self.index.get, units, repeat(-1)), dtype=np.int64, count=len(units))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stored units one after the other, and where each ends."""
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[at] - (ends - sizes), sizes)
        shift += np.arange(len(shift))
        return self.flat[shift], ends

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Encode new units and say where they are; those that are letters and a mark are put together from their distinct parts."""
        parts = pc.extract_regex(units, MARKED)
        if self.words:  # a line or zero in a unit is no part of a word there
            parts = pc.if_else(pc.equal(pc.binary_join_element_wise(pc.struct_field(parts, "zero"), pc.struct_field(parts, "line"), ""), ""), parts, None)
        simple = parts.is_valid()
        parts, own = parts.filter(simple), units.filter(simple)
        zero, line, word, mark = (pc.struct_field(parts, n) for n in ("zero", "line", "word", "mark"))
        bare = pc.or_(pc.equal(line, "\n"), pc.equal(zero, "\x00"))
        word = pc.ascii_lower(word) if self.words else pc.binary_join_element_wise(pc.if_else(bare, "\x00", ""), word, "")
        coded = word.dictionary_encode()
        bases = _strings(coded.dictionary)
        good = pc.string_is_ascii(coded.dictionary).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(~good).tolist():
            good[i] = self._letters(bases[i].removeprefix("\x00"))
        place = self._places(bases)
        need = np.flatnonzero(good & (place < 0)).tolist()
        first = [i for i in need if bases[i][0] == "\x00"]
        inner = [i for i in need if bases[i][0] != "\x00"] if first else need
        place[inner] = len(self.index) + np.arange(len(inner))
        self._encode_letters([bases[i] for i in inner])
        keep = good[coded.indices.to_numpy()]
        signs = {x if self.words else "\x00" + x: 0 for x in pc.unique(mark).to_pylist() if x}
        if not self.words:
            signs["\x00\n"] = 0
        other = ~simple.to_numpy(zero_copy_only=False)
        other[~other] = ~keep
        rest = _strings(units.filter(pa.array(other)))
        place[first] = len(self.index) + np.arange(len(first))
        self._encode_units([bases[i] for i in first])
        self._encode_units([x for x in signs if x not in self.index])
        at = np.empty(len(units), dtype=np.int64)
        # a unit of the rest may be there by now: a line break alone, or a text's first unit that is a mark
        held = self._places(rest)
        fresh = np.flatnonzero(held < 0)
        held[fresh] = len(self.index) + np.arange(len(fresh))
        self._encode_units([rest[i] for i in fresh.tolist()])
        at[other] = held
        made = keep & pc.not_equal(own, word).to_numpy(zero_copy_only=False)
        where = np.flatnonzero(~other)
        same = keep & ~made
        at[where[same[keep]]] = place[coded.indices.to_numpy()[same]]
        if not made.any():
            return at
        put = pa.array(made)
        middle = place[coded.indices.to_numpy()[made]]
        marks = mark.filter(put).dictionary_encode()
        after = np.array([self.index[x if self.words else "\x00" + x] if x else -1 for x in marks.dictionary.to_pylist()], dtype=np.int64)[marks.indices.to_numpy()]
        before = np.where(pc.equal(line.filter(put), "\n").to_numpy(zero_copy_only=False), self.index.get("\x00\n", -1), -1)
        parts_at = np.column_stack([before, middle, after])
        ids, ends = self._gather(parts_at[parts_at >= 0])
        last = np.cumsum((parts_at >= 0).sum(axis=1)) - 1
        at[where[made[keep]]] = len(self.index) + np.arange(len(last))
        self._append(_strings(own.filter(put)), ids, np.diff(ends[last], prepend=0))
        return at

    def _shrink(self, units: list[str]) -> None:
        """Keep only the given units."""
        at = self._places(units)
        ids, sizes = self._gather(at)[0], self.lengths[at]
        self.index, self.used = {}, 0
        self._append(units, ids, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        gc.disable()  # many short lists and no cycles: collections would only walk the store
        try:
            return self._encode(texts)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsure = pc.match_substring_regex(texts, self.unsure)
        safe = pc.if_else(unsure, "", texts)
        if self.words:
            cut = pc.ascii_split_whitespace(safe)
        else:
            cut = pc.split_pattern(pc.binary_join_element_wise("\x00", pc.replace_substring(safe, "\n", " \n"), ""), " ")
        coded = cut.flatten().dictionary_encode()
        units = _strings(coded.dictionary)
        own = self._places(units)
        new = own < 0
        if new.any():
            if len(self.index) + new.sum() > UNITS_KEPT:
                self._shrink([u for u, n in zip(units, new.tolist(), strict=True) if not n])
                own[~new] = np.arange(len(self.index))
            own[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        flat, ends = self._gather(own[coded.indices.to_numpy()])
        per = np.diff(cut.offsets.to_numpy())
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        counts = np.diff(bounds)
        whole = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
        if len(whole):
            direct = self.tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in whole], add_special_tokens=False)
            pieces = [flat[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            for i, e in zip(whole.tolist(), direct, strict=True):
                pieces[i] = np.array(e.ids, dtype=np.uint32)
                counts[i] = len(pieces[i])
            flat = np.concatenate(pieces)
        return flat, counts


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One store per worker process and vocabulary; it lives on from task to task."""
    return Encoder(path)


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every text's ids."""
    return np.insert(flat, np.cumsum(counts), np.uint32(end_id)).astype(np.uint32, copy=False), counts + 1
