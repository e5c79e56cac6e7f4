"""Token ids of whole texts from the tokenizers library, with repeated words encoded once per worker.

Both vocabularies here split a text at white space before they merge, so a text is the concatenation of units that encode on their own.
The units a worker has not met lately are normalised and cut into words together, and each new word goes to the library's model. Texts in which
a special token's string occurs, or whose white space does not split this way, go to the library whole. The ids are those of the
library's own encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .worker import BUDGET, Recent, held, spread

#: White space other than space, tab, line feed and carriage return.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_SPACED = r"[\n\t\r ] |[\t\r]"
#: Libraries may class characters from here on by different versions of Unicode; words with these go to the tokenizer as they are.
_STABLE = "԰"
#: The split rule of the byte-level pre-tokenizer, and its visible form of each byte.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]


def _visible() -> dict[int, str]:
    hidden = iter(range(256, 512))
    shown = set(_SHOWN)
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


def _ascii_rule(rule: str) -> str:
    """The split rule for texts of ASCII."""
    bare = rule.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"\s\p{L}\p{N}]", r"\sA-Za-z0-9]")
    return bare.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


def encoder(path: str, budget: int = BUDGET) -> "UnitEncoder":
    """This worker's encoder of a vocabulary file."""
    return held(("units", path, budget), lambda: UnitEncoder(path, budget))


class UnitEncoder:
    """Encodes columns of texts."""

    def __init__(self, path: str, budget: int = BUDGET):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in described["added_tokens"]]
        pre = described["pre_tokenizer"]
        self.keeps_space = pre["type"] == "ByteLevel"
        rule = _BYTE_WORDS if self.keeps_space else pre["pretokenizers"][0]["pattern"]["Regex"]
        self.cut, self.cut_ascii = regex.compile(rule).findall, re.compile(_ascii_rule(rule), re.ASCII).findall
        self.visible = _visible()
        odd = [re.escape(t) for t in self.special] + ["\0"]
        self.no_split = "|".join([*odd, _SPACED, _RARE_SPACE.pattern] if self.keeps_space else odd)
        self.units = Recent(budget * 3 // 4)
        self.words = Recent(budget // 4)

    def _merge(self, words: list[str]) -> None:
        """Each word's ids from the library's model."""
        shown = "\0".join(words).encode().decode("latin-1").translate(self.visible).split(self.visible[0]) if words else []
        tokenize = self.tokenizer.model.tokenize
        self.words.put(words, [array("I", [t.id for t in tokenize(form)]).tobytes() for form in shown])

    def _learn(self, new: list[str]) -> list[bytes]:
        """Cut new units into words, merge each new word once, and put the units' ids together."""
        kinds: tuple[list[int], list[int], list[int]] = [], [], []
        for k, u in enumerate(new):
            kinds[0 if u.isascii() else 2 if max(u) >= _STABLE or _RARE_SPACE.search(u) else 1].append(k)
        plain, other, odd = kinds
        low, forms = [new[k] for k in plain], [new[k] for k in other]
        if not self.keeps_space:
            low = "\n".join(low).lower().split("\n") if plain else []
            forms = self.tokenizer.normalizer.normalize_str("\n".join(forms)).split(" ") if other else []
            if len(forms) != len(other):
                odd += other
                forms = other = []
        cuts = [*map(self.cut_ascii, low), *map(self.cut, forms)]
        self._merge(self.words.missing(set().union(*cuts)))
        words = self.words.now
        out = [b""] * len(new)
        for k, ws in zip(plain + other, cuts, strict=True):
            out[k] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        for k in odd:
            out[k] = self._whole(new[k])
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, texts: pa.Array) -> pa.ListArray:
        if self.keeps_space:
            return pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        return pc.ascii_split_whitespace(texts)

    def _ids(self, distinct: list[str]) -> list[bytes]:
        self.units.turn(), self.words.turn()
        return self.units.look_up(distinct, self._learn)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin and end (one more than there are texts). Null is empty."""
        texts = texts.fill_null("")
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the tables are large to walk
        try:
            odd = pc.match_substring_regex(texts, self.no_split)
            whole = {int(k): self._whole(texts[int(k)].as_py()) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
            return spread(self._units(pc.if_else(odd, "", texts)), whole, self._ids)
        finally:
            if collects:
                gc.enable()
