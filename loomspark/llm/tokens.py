"""Public tokenizers inside Python workers: loading, and exact per-word caches."""

from __future__ import annotations

import functools
import re


def path(name: str, folder: str | None = None) -> str:
    """A tokenizer file in ``folder``, or where the package of public tokenizers keeps it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


#: Entries a cache may hold in one worker before its younger half goes.
CACHE_LIMIT = 300_000


def trim(cache: dict) -> None:
    """Keep a cache within its limit; what came first is what texts use most."""
    if len(cache) > CACHE_LIMIT:
        for key in list(cache)[CACHE_LIMIT // 2 :]:
            del cache[key]


@functools.lru_cache(maxsize=8)
def load(path: str):
    """The tokenizer of a .json file, one instance for each worker process."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def special_pattern(tokenizer) -> re.Pattern | None:
    """Matches the strings that the library takes out of a text before anything else."""
    names = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def byte_characters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte: itself if it has one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


_BYTE = byte_characters()


def as_bytes(piece: str) -> str:
    """A piece as a string with a character for each of its UTF-8 bytes."""
    return "".join([_BYTE[b] for b in piece.encode()])


#: Words of these characters alone are the same for all rules about letters, case and composition.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How such a word, in lower case, falls into pieces.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordIds:
    """Token ids of texts for the lower-casing tokenizer that drops white space.

    It never joins characters across ASCII white space, so the ids of a text are
    those of its words in turn; each distinct word is encoded once.  Plain words are
    cut into pieces here, and each distinct piece goes through the tokenizer's merges;
    all others go through the whole tokenizer.  ``ids`` gives unsigned little-endian
    32-bit numbers.
    """

    def __init__(self, path: str):
        tokenizer = load(path)
        self._encode, self._merge = tokenizer.encode, tokenizer.model.tokenize
        self._known: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self._pieces.get(piece)
        if got is None:
            got = b"".join([t.id.to_bytes(4, "little") for t in self._merge(as_bytes(piece))])
            if len(piece) <= 48:
                trim(self._pieces)
                self._pieces[piece] = got
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            got = b"".join([self._piece(p) for p in _PIECES.findall(text.lower())])
        else:
            got = b"".join([i.to_bytes(4, "little") for i in self._encode(text, add_special_tokens=False).ids])
        if len(word) <= 64:
            self._known[word] = got
        return got

    def ids(self, text: str) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split()
        known = self._known
        trim(known)
        get, made = known.get, self._word
        return b"".join([made(w) if (got := get(w)) is None else got for w in words])
