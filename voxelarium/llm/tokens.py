"""Token counts with a whole-token shortcut, and token ids through a memo of pre-tokens.

A byte-level BPE encodes each pre-token on its own.  Before the job starts, the driver
asks the tokenizer's own model for every vocabulary string alone and keeps those that come
back as one token.  In the texts such pre-tokens count one; only the rest is merged, by
the same model, and remembered up to a bound.

The memo works on stretches between blanks: no pre-token crosses the edge of a stretch
that neither starts nor ends with white space.  Texts without such a split (runs of blanks,
say) go through the pattern as a whole.  The pattern is spelled out in the characters below
``SAFE_END`` (the tests compare both libraries for every such character); texts with other
characters are split by the tokenizer itself.  Strings of special tokens inside a text are
one token each, as the library does by default.

Defined results: null text is empty and has no tokens; repeated rows each get their row;
result columns replace input columns of the same name, others pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from voxelarium.llm.common import carries, text_or_empty, with_result

#: Tokens over which a text is marked.
LIMIT = 512
#: Stretches, and pre-tokens, that a worker remembers besides the proven ones, and the longest of them.
MEMO = 300_000
REMEMBERED = 48

#: The patterns of the two tokenizer files; fixed values.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Below this both libraries agree on the classes.  Left out: U+0130, which lower case makes two characters of,
#: and U+001C to U+001F, which ``str.split`` takes for white space.
SAFE_END = 0x180
_UNSAFE = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")


def safe_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for safe texts: its classes as lists of characters, letters tried first.

    No other alternative starts with a letter, nor with a space before one, so the order
    does not matter for the result.
    """

    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(SAFE_END) if regex.match(kind, chr(c)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    parts = pattern.split("|")
    parts.sort(key=lambda p: r"\p{L}" not in p or r"\p{N}" in p)
    out = "|".join(parts)
    for kind, chars in ((r"\s+(?!\S)", f"[{space}]+(?![^{space}])"), (r"\s\p{L}\p{N}", space + letter + number)):
        out = out.replace(kind, chars)
    for kind, chars in ((r"[\p{L}]", letter), (r"[\p{N}]", number), (r"\p{L}", letter), (r"\p{N}", number), (r"\s", space)):
        out = out.replace(kind, f"[{chars}]")
    return re.compile(out)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 as it is, all others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the model encodes alone as one token."""
    tokenizer = Tokenizer.from_file(path)
    bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
    proven = set()
    for shown in tokenizer.get_vocab(with_added_tokens=False):
        if len(tokenizer.model.tokenize(shown)) == 1:
            try:
                proven.add(bytes(bytes_of[c] for c in shown).decode())
            except (UnicodeDecodeError, KeyError):
                pass  # part of a character: never a pre-token
    return frozenset(proven)


class Memo(dict):
    """What ``work`` makes of strings; remembers short ones, a bounded number, so bounded bytes.

    Half of them are the newest; those before are kept until as many newer ones are known,
    so strings that come often stay.  ``base`` stays as it is.
    """

    def __init__(self, work: Callable[[str], object], base: dict[str, object] | None = None, size: int = MEMO):
        super().__init__()
        self.work, self.base, self.half, self.older = work, base or {}, size // 2, {}

    def __missing__(self, text: str):
        value = self.base.get(text)
        if value is None:
            value = self.older.get(text)
        if value is None:
            value = self.work(text)
        if len(text) <= REMEMBERED:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


class PreTokens:
    """A tokenizer file opened in a worker: special strings, pre-tokens, merges.

    ``of_piece`` and ``of_stretch`` remember what ``value`` and ``stretch`` make of them.
    """

    def __init__(self, path: str, pattern: str, base: dict[str, object]):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = safe_pattern(pattern).findall
        self.alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.of_piece, self.of_stretch = Memo(self.piece, base), Memo(self.stretch)

    def value(self, ids: list[int]):
        raise NotImplementedError

    def stretch(self, text: str):
        raise NotImplementedError

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    @staticmethod
    def safe(text: str) -> bool:
        return _UNSAFE.search(text) is None

    def piece(self, piece: str):
        """Value of one pre-token, merged now."""
        plain = piece.isascii() and piece.isprintable() and " " not in piece  # such characters stand for themselves
        shown = piece if plain else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return self.value([t.id for t in self.model.tokenize(shown)])


class TokenCounter(PreTokens):
    #: Count of a stretch that white space at its edge keeps from standing alone.
    OPEN_EDGE = -(1 << 60)

    def __init__(self, path: str, proven: frozenset[str]):
        super().__init__(path, BYTE_PATTERN, base=dict.fromkeys(proven, 1))
        self.byte = {c: b for b, c in enumerate(self.alphabet)}

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def stretch(self, text: str) -> int:
        """Tokens of a blank and ``text``."""
        if not text or text[0].isspace() or text[-1].isspace():
            return self.OPEN_EDGE
        return sum(map(self.of_piece.__getitem__, self.find(" " + text)))

    def count(self, text: str) -> int:
        parts = self.cut.split(text) if self.has_special(text) else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if not self.safe(text):
            shown = (p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            return sum(self.of_piece[bytes(map(self.byte.__getitem__, p)).decode()] for p in shown)
        first, *stretches = text.split(" ")
        if stretches and not first[-1:].isspace():
            count = sum(map(self.of_stretch.__getitem__, stretches))
            if count >= 0:
                return count + sum(map(self.of_piece.__getitem__, self.find(first)))
        return sum(map(self.of_piece.__getitem__, self.find(text)))


#: Counters of this worker process by file; a worker serves many tasks.
_OPEN: dict[str, TokenCounter] = {}


@carries("text_column")
def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    path = path or default_path("byte_bpe_50k.json")
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        if path not in _OPEN:
            _OPEN[path] = TokenCounter(path, proven.value)
        return pd.Series(list(map(_OPEN[path].count, texts)), dtype="int64")

    text = text_or_empty(text_column)
    counted = with_result(docs, n_bytes=F.octet_length(text).cast("long"), n_tokens=tokens(text))
    return with_result(counted, over_limit=F.col("n_tokens") > limit)


def token_counts(docs: DataFrame) -> DataFrame:
    """The registered form."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
