"""Token ids of whole texts from a public tokenizer file."""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from themescope.llm.textcodes import DIGIT, OTHER, SPACE, classes

END_ID = 2
#: Distinct words, and words with punctuation, whose ids a worker keeps (about 250 bytes each).
CACHE_WORDS = 500_000
#: Distinct words that go through the library at a time.
CHUNK = 4096
#: Words whose ids are put together at a time.
GATHER = 1 << 20
#: Classes beside those of ``textcodes``: the end of a text; characters of which Python and the
#: pattern may think differently (control characters that are space to Python, unassigned code points).
END, ODD = OTHER + 1, OTHER + 2

# --- fixed values: how byte-level BPE splits a text into words ----------------
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Before lower case, either case of an English contraction.
CONTRACTIONS = {"'s": "'[sS]", "'t": "'[tT]", "'re": "'[rR][eE]", "'ve": "'[vV][eE]", "'m": "'[mM]",
                "'ll": "'[lL][lL]", "'d": "'[dD]"}
# The one character whose lower case is several.
LONG_LOWER = "\u0130"
# ------------------------------------------------------------------------------


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(1)
def _kinds() -> np.ndarray:
    kinds = classes().copy()
    kinds[0x1C:0x20] = ODD
    kinds[[i for i in np.flatnonzero(kinds == OTHER).tolist() if unicodedata.category(chr(i)) == "Cn"]] = ODD
    return kinds


class WordEncoder:
    """Encodes texts word by word: BPE never merges across the words of the
    tokenizer's own splitting pattern, so each distinct word goes through the
    library once and repeated ones come from a bounded cache.  It has two
    generations: words seen since the older one was put away outlive it.  A batch
    of texts is split by NumPy and its words numbered in Arrow, so that each
    different word is looked up once a batch; NumPy puts the ids in place.  New words of
    Latin-1 letters go through the library's model, other words of letters
    through all of it many at a time, as one text; the tokens that end (or, with
    their space, start) a word tell them apart.  Texts that
    hold the string of an added token, or a character whose lower case is
    several characters, go through it whole.  Ids are packed as little-endian
    unsigned 32-bit integers."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.nfc = "NFC" in kinds
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not kinds:
            pattern = BYTE_LEVEL
        elif pre["type"] == "Sequence" and pre["pretokenizers"][0]["type"] == "Split" and pre["pretokenizers"][0]["invert"]:
            parts = pre["pretokenizers"][0]["pattern"]["Regex"].split("|")
            pattern = "|".join(CONTRACTIONS.get(p, p) for p in parts) if "Lowercase" in kinds else "|".join(parts)
        else:
            raise ValueError(f"no word pattern known for the pre-tokenizer of {path}")
        self.words = regex.compile(pattern).findall
        if any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"added tokens of {path} are looked for in normalised text")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if "Lowercase" in kinds:
            self.special.append(LONG_LOWER)
        self.lower = "Lowercase" in kinds
        self.tokenize = self.tok.model.tokenize
        # Byte-level characters: bytes that are no visible Latin-1 character stand behind it, in their order.
        hidden = [*range(33), *range(127, 161), 173]
        self.bytes = np.arange(256, dtype="<u4")
        self.bytes[hidden] = 256 + np.arange(len(hidden))
        self.bytes[10] = 10                               # words stand in lines here
        self.leading = pattern is BYTE_LEVEL              # a word may start with its space
        vocab, suffix = self.tok.get_vocab(), spec["model"].get("end_of_word_suffix")
        self.edge = None                                  # by id: first token of a word with its space, or last token
        if self.leading or suffix:
            self.edge = np.zeros(max(vocab.values()) + 1, bool)
            self.edge[[i for t, i in vocab.items() if (t[0] == "Ġ" if self.leading else t.endswith(suffix))]] = True
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words = cache_words

    def first_of_words(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a word, or a run of white space between words, begins at each code point: the
        tokenizer's splitting pattern for all texts at once.  ``kinds`` end with two ``END``."""
        new = np.concatenate(([True], kinds[1:] != kinds[:-1])) | (kinds == END)
        if self.leading:                                  # the last space of a run belongs to the word behind it
            last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != END))
            new[last] = True
            new[last[points[last] == 32] + 1] = False
        else:
            new |= kinds == DIGIT
        quote = np.flatnonzero(new[:-2] & (points[:-2] == 39))
        one, two = points[quote + 1], points[quote + 2]
        if self.lower:
            one, two = (np.where((x >= 65) & (x <= 90), x + 32, x) for x in (one, two))
        n = np.isin(one, [ord(c) for c in "stmd"]) + sum(2 * ((one == ord(a)) & (two == ord(b))) for a, b in ("re", "ve", "ll"))
        quote, n = quote[n > 0], n[n > 0]
        new[quote + 1] = False
        new[quote + 1 + n] = True
        return new

    def numbered(self, text: str, points: np.ndarray, kinds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(codes, ends, words): the words of ``n`` texts, one after another, as places in a list of
        different words, numbered by Arrow; ends count the words of all texts so far."""
        data = np.frombuffer(text.encode(), np.uint8)
        new = self.first_of_words(points, kinds)
        at = np.flatnonzero(new)
        kind = kinds[at]
        if len(data) > len(points):
            at = np.flatnonzero(data.view(np.int8) >= -64)[at]  # bytes that begin a character
        offsets = np.append(at, len(data))
        made = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        words = kind != END if self.leading else (kind != END) & (kind != SPACE)
        ends = np.cumsum(words)[np.flatnonzero(kind == END)[:n]]
        return made.indices.to_numpy()[words], ends, made.dictionary.to_numpy(zero_copy_only=False).tolist()

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by the library alone."""
        out = []
        for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            ids = array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(ids.tobytes())
        return out

    def joined(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, encoded as one text; one by one where the edges don't add up."""
        if self.edge is None or len(words) < 2:
            return self.packed(words)
        text = ("" if self.leading else " ").join(words)
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self.packed(words)
        at = (4 * (np.append(at, len(ids)) if self.leading else np.append(0, at + 1))).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def alone(self, words: list[str]) -> list[bytes]:
        """Ids of plain words of Latin-1, whose classes and lower case are the same in all versions of
        Unicode: the library's model alone, as its other steps have nothing to do but map the bytes."""
        if self.lower:
            words = "\n".join(words).lower().split("\n")
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        words = self.bytes[data].tobytes().decode("utf-32-le").split("\n")
        ids, ends = array("I"), []
        for tokens in map(self.tokenize, words):
            ids.extend([t.id for t in tokens])
            ends.append(4 * len(ids))
        if sys.byteorder == "big":
            ids.byteswap()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def whole(self, text: str) -> bool:
        """Whether the text must go through the library whole: case matters here."""
        return any(s in text for s in self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        normal = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts] if self.nfc else texts
        whole = [i for i, (t, x) in enumerate(zip(texts, normal)) if self.whole(t) or x is not t and self.whole(x)]
        if not whole:
            return self.by_words(normal)
        return self.with_others(normal, dict(zip(whole, self.packed([texts[i] for i in whole]))))

    def with_others(self, texts: list[str], found: dict[int, bytes]) -> list[bytes]:
        """Ids of each text; those of some are found."""
        rest = iter(self.by_words([t for i, t in enumerate(texts) if i not in found]))
        return [found[i] if i in found else next(rest) for i in range(len(texts))]

    def learn(self, words: list[str]) -> None:
        """Put the ids of ``words`` into the cache."""
        latin, wide, other = [], [], []
        for w in set(words):
            if w in self.old:
                self.cache[w] = self.old[w]
            elif w.isalpha() or self.leading and w[0] == " " and w[1:].isalpha():
                if w.isascii() or max(w) <= "\xff":
                    latin.append(w)
                else:
                    (wide if w[0] == " " or not self.leading else other).append(w)
            else:
                other.append(w)
        for some, encode in ((latin, self.alone), (wide, self.joined), (other, self.packed)):
            for at in range(0, len(some), CHUNK):
                self.cache.update(zip(some[at:at + CHUNK], encode(some[at:at + CHUNK])))

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        found = list(map(self.cache.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            self.learn([words[i] for i in new])
            for i in new:
                found[i] = self.cache[words[i]]
        return found

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are normalised already."""
        if not texts:
            return []
        if len(self.cache) > self.cache_words // 2:
            self.old, self.cache = self.cache, {}
        text = "\n".join([*texts, "\n"])
        points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = _kinds()[points]
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        odd = np.unique(np.searchsorted(stop, np.flatnonzero(kinds == ODD))).tolist()
        if odd:
            return self.with_others(texts, {i: b"".join(self.known(self.words(texts[i]))) for i in odd})
        kinds[stop] = kinds[-1] = END
        codes, ends, words = self.numbered(text, points, kinds, len(texts))
        known = self.known(words)
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        if max(len(ids), GATHER * int(size.max())) < 1 << 31:
            size, first = size.astype(np.int32), first.astype(np.int32)
        out, to = [], [np.zeros(1, np.int64)]
        for at in range(0, len(codes), GATHER):
            some = codes[at:at + GATHER]
            n = size[some]
            end = np.cumsum(n, dtype=n.dtype)
            out.append(ids[np.repeat(first[some] - end + n, n) + np.arange(end[-1], dtype=n.dtype)].tobytes())
            to.append(end + to[-1][-1])
        data = b"".join(out)
        cuts = [0, *(4 * np.concatenate(to)[ends]).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def end_bytes(end_id: int) -> bytes:
    return int(end_id).to_bytes(4, "little")


def encoded_rows(batches, path: str, end_id: int, text_col: str = "text", rows: int = 512, chars: int = 1 << 21):
    """(batch, row number, ids) of every row: ids with the end id; null text is empty.
    A few hundred texts, or two million characters, are encoded at a time."""
    encode, end = encoder(path), end_bytes(end_id)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col))
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at + len(some) < len(texts) and len(some) < rows and size < chars:
                some.append(texts[at + len(some)].as_py() or "")
                size += len(some[-1])
            for k, ids in enumerate(encode(some)):
                yield batch, at + k, ids + end
            at += len(some)
