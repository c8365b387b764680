"""The tokenizer of full-text search as a column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates tokens, Unicode white space and ASCII punctuation.
SEPARATORS = r"\x09-\x0D\x{85}\p{Z}!-/:-@\[-`{-~"


@dataclass(frozen=True)
class Tokenizer:
    """Lengths are bytes of UTF-8, before lower-casing."""

    min_length: int = 1
    max_length: int = 256
    case_sensitive: bool = False
    extra_separators: str = ""

    @property
    def pattern(self) -> str:
        extra = "".join(f"\\x{{{ord(c):x}}}" for c in self.extra_separators)
        return f"[{SEPARATORS}{extra}]+"

    def tokens(self, text: Column) -> Column:
        """Tokens in order, with repeats; null has none."""
        parts = F.split(F.coalesce(text, F.lit("")), self.pattern)
        fit = F.filter(parts, lambda t: F.octet_length(t).between(max(self.min_length, 1), self.max_length))
        return fit if self.case_sensitive else F.transform(fit, F.lower)

    def of(self, text: str) -> list[str]:
        """The same for one text, on the driver, for queries."""
        space = "\t\n\x0b\x0c\r\x85 \xa0  -     　"
        parts = re.split(f"[{space}!-/:-@\\[-`{{-~{re.escape(self.extra_separators)}]+", text)
        fit = [t for t in parts if max(self.min_length, 1) <= len(t.encode()) <= self.max_length]
        return fit if self.case_sensitive else [t.lower() for t in fit]
