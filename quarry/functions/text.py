"""Text expressions, all but other tokenizers than the plain one in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The code points that count as white space when a text is stripped.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

#: A token: letters and digits, no underscore.
TOKEN = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonicalize(c: Column | str) -> Column:
    """CRLF and lone CR become LF."""
    return F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip(c: Column | str) -> Column:
    """White space of any script is cut from both ends."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Letters whose decomposition is one base and marks, and their bases."""
    source, base = [], []
    for cp in range(0xC0, 0x10000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", chr(cp))
        kept = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(parts) > 1 and len(kept) == 1:
            source.append(chr(cp)), base.append(kept[0])
    return "".join(source), "".join(base)


def fold_accents(c: Column | str) -> Column:
    """Letters without their marks. Hangul syllables stay composed."""
    return F.translate(_col(c), *_folds())


def tokens(c: Column | str) -> Column:
    """array<string>: tokens first, then lower case, then without accents. A
    combining mark ends a token. Null gives null, no token an empty array."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0)), lambda t: fold_accents(F.lower(t)))


def _plain_terms(text: str) -> list[str]:
    fold = _fold_table()
    return [t.lower().translate(fold) for t in _RUNS(text)]


def _singular_terms(text: str) -> list[str]:
    """Terms without a plural s: 'leis' and 'lei' are one."""
    return [t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t for t in _plain_terms(text)]


_RUNS = re.compile(r"[^\W_]+").findall


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    return dict(zip(map(ord, _folds()[0]), _folds()[1]))


#: Tokenizers by name; others can be added. 'plain' is ``tokens``, which stays in the JVM.
TOKENIZERS: dict[str, Callable[[str], list[str]]] = {"plain": _plain_terms, "singular": _singular_terms}


def build_tokenizer(name: str) -> Callable[[str], list[str]]:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {name!r}")
    return TOKENIZERS[name]


def tokenized(c: Column | str, name: str = "plain") -> Column:
    """array<string>: a text's terms by a tokenizer of the registry; null gives null."""
    split = build_tokenizer(name)
    if name == "plain":
        return tokens(c)

    @arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else split(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(_col(c))


def strip_html(c: Column | str) -> Column:
    """Tags become spaces, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", " "), f"[{WHITE_SPACE}]+", " "))


def char_cap(c: Column | str, most: int) -> Column:
    return F.left(_col(c), F.lit(most))


def without_suffix(c: Column | str, suffix: str) -> Column:
    """The text without ``suffix`` at its end."""
    c = _col(c)
    return F.when(F.endswith(c, F.lit(suffix)), F.left(c, F.char_length(c) - len(suffix))).otherwise(c)


def preview(c: Column | str, most: int = 220) -> Column:
    """One line, cut to ``most`` characters with '...' where it was longer."""
    line = F.replace(_col(c), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("..."))).otherwise(line)
