"""Tokens by a byte-pair vocabulary: counts for whole texts, and ids for chunks that must fit a model's window."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Runs of white space from which on a text is cut by the `regex` module: the encoder's own matcher recurses on them and overflows.
RUN = 10_000
#: A pattern that cuts nothing.
WHOLE = "(?s:.+)"


@lru_cache(maxsize=8)
def _encoding(ranks: bytes, pattern: str):
    """One encoder a worker, vocabulary and pattern, however many batches it serves."""
    import base64

    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("casemill", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@dataclass(frozen=True)
class BytePairs:
    """A vocabulary as its rank file (a token in base64 and its rank a line) and the pattern that cuts a text before the merges.

    It travels to the executors with the plan, less than a megabyte for 50,000 tokens, so they need no file.  Names of special tokens
    in a text are ordinary text.
    """

    ranks: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        return cls(Path(path).read_bytes(), pattern)

    def ids(self, text: str) -> list[int]:
        import regex

        if len(text) >= RUN and regex.search(rf"\s{{{RUN}}}", text):
            whole = _encoding(self.ranks, WHOLE)
            return [i for piece in regex.findall(self.pattern, text) for i in whole.encode_ordinary(piece)]
        return _encoding(self.ranks, self.pattern).encode_ordinary(text)

    def text(self, ids: list[int]) -> str:
        """The text of ids; bytes of a character that is cut become the replacement character."""
        return _encoding(self.ranks, self.pattern).decode(ids)

    def count(self, text: Column) -> Column:
        """How many tokens a whole text has; null has none."""

        @F.arrow_udf("int")
        def counted(texts):
            import pyarrow as pa

            return pa.array([len(self.ids(t)) if t else 0 for t in texts.to_pylist()], pa.int32())

        return counted(text)
