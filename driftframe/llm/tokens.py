"""Memoised pre-token encoding for the two byte-level BPE files.

A byte-level BPE encodes each pre-token on its own, so ids of a text are the joined ids of its
pre-tokens. For plain texts (no control characters, nothing beyond U+00FF, no special string) the
pre-tokens are found with the classes written out below and only those not met before go to the
``tokenizers`` library; any other text goes to the library whole, and so do all texts if the file's own
normaliser and pre-tokeniser aren't those below. Both ways give the library's ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r "
_SPECIAL = re.compile("[^\t-\r -~\xa1-\xff]|<\\|")
_KINDS = {
    # name: pattern, lower-cased first
    "byte": (re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"), False),
    "word": (re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"), True),
}
# What the files of each kind say of normaliser and pre-tokeniser.
_FILES = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
}
#: Pre-tokens remembered at most by a worker; beyond it the memory starts anew.
MEMO = 1_000_000
_open: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            said = json.load(f)
        #: Whether plain texts may be cut into pre-tokens here.
        self.known = (said.get("normalizer"), said.get("pre_tokenizer")) == _FILES[kind] and all(t["content"].startswith("<|") for t in said.get("added_tokens", ()))
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern, self.lower = _KINDS[kind]
        self.memo: dict[str, bytes] = {}
        #: Of a vocabulary with word ends: whether an id ends its pre-token.
        self.ends = None
        if kind == "word":
            self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        if self.ends is not None:  # one call for all: each pre-token ends with the only id that is a word end
            ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                whole, a = ids.tobytes(), 0
                for w, b in zip(words, (4 * stops).tolist()):
                    self.memo[w] = whole[a:b]
                    a = b
                return
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)):
            self.memo[w] = _packed(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added special tokens."""
        out: list[bytes] = []
        for text in texts:
            if not self.known or _SPECIAL.search(text):
                out.append(_packed(self.library.encode(text, add_special_tokens=False).ids))
                continue
            words = self.pattern.findall(text.lower() if self.lower else text)
            try:
                out.append(b"".join(map(self.memo.__getitem__, words)))
            except KeyError:
                missing = list({w for w in words if w not in self.memo})
                if len(self.memo) + len(missing) > MEMO:
                    self.memo, missing = {}, list(set(words))
                self._learn(missing)
                out.append(b"".join(map(self.memo.__getitem__, words)))
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and file."""
    if (path, kind) not in _open:
        _open[path, kind] = Encoder(path, kind)
    return _open[path, kind]


def version(path: str) -> str:
    """Digest of a tokenizer's file and its library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()
