"""Token counts of a public tokenizer, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Folder and file of the vocabulary; the tokenizer is byte-level BPE for many languages, 50,256 ids.
TOKENIZERS, VOCABULARY = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken"
#: Characters after which a long text is parted for encoding, at the next place where a word begins behind a single space: the vocabulary's
#: pattern begins a piece there anyway, so the count is that of the whole text.
STRETCH = 200_000
PART = re.compile(r"(?<=\S) (?=[^\W\d_])")


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_multi_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, folder: str = TOKENIZERS) -> int:
    if not text:
        return 0
    e = encoder(folder)
    if len(text) <= STRETCH:
        return len(e.encode_ordinary(text))
    n = i = 0
    while i < len(text):
        m = PART.search(text, i + STRETCH)
        j = m.start() if m else len(text)
        n += len(e.encode_ordinary(text[i:j]))
        i = j
    return n
