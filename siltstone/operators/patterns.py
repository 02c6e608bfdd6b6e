"""Very many patterns over very many texts: one automaton over the fixed parts of all of them, and a pattern is tried only where its part stands."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT = "__slot__"
#: Patterns, and bytes of them, of a pass over the texts: what the driver and every worker hold.
AT_ONCE, BYTES_AT_ONCE = 200_000, 32 << 20

#: A worker's last automaton, by the name of its patterns.
_made: dict[str, tuple] = {}


def anchor(signature: str) -> str:
    """The longest part of a signature between two slots; empty if there is none."""
    return max(signature.split(SLOT), key=len)


class Matcher:
    """Signatures by their anchors; the automaton is made once in every worker."""

    def __init__(self, signatures: list[str]):
        self.signatures, self.name = signatures, uuid.uuid4().hex

    def _automaton(self) -> tuple:
        import ahocorasick

        if self.name not in _made:
            by_anchor: dict[str, list[int]] = {}
            for k, s in enumerate(self.signatures):
                by_anchor.setdefault(anchor(s), []).append(k)
            always = by_anchor.pop("", [])
            found = ahocorasick.Automaton()
            for a, numbers in by_anchor.items():
                found.add_word(a, (a, numbers))
            found.make_automaton()
            _made.clear()
            _made[self.name] = found, always, {}
        return _made[self.name]

    def matches(self, text: str) -> list[int]:
        """Numbers of the signatures of which the text is, a slot standing for one character or more."""
        automaton, always, patterns = self._automaton()
        near = {a: numbers for _, (a, numbers) in automaton.iter(text)} if len(automaton) else {}
        out = []
        for k in (*always, *(k for numbers in near.values() for k in numbers)):
            if k not in patterns:
                patterns[k] = [re.escape(p) for p in self.signatures[k].split(SLOT)]
            first, *rest = self.signatures[k].split(SLOT)
            # Most candidates differ at an end, which costs no pattern.
            if text.startswith(first) and text.endswith(rest[-1]) and re.fullmatch(".+?".join(patterns[k]), text):
                out.append(k)
        return sorted(out)


def slotted_matches(texts: DataFrame, text: str, signature: str, signatures: list[str]) -> DataFrame:
    """texts with each signature of the list that they match."""
    matcher, names = Matcher(signatures), texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, x in enumerate(batch.column(text).to_pylist()):
                for k in matcher.matches(x) if x else ():
                    rows.append(i)
                    found.append(matcher.signatures[k])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(found, pa.string())], names=[*names, signature])

    return texts.mapInArrow(run, texts.withColumn(signature, F.lit("")).schema)


def signature_matches(signatures: DataFrame, texts: DataFrame, signature: str, text: str, at_once: int = AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """Texts that match a template signature, __slot__ standing for any words.

    Signatures without a slot are an equi-join. The others are found in one pass over the texts: an automaton finds the fixed parts of all
    of them at once, so the work grows with the texts and their hits. More than at_once signatures, or bytes, take further passes.
    """
    distinct = signatures.select(signature).where(F.col(signature).isNotNull()).distinct()
    slotted = F.col(signature).contains(SLOT)
    out = texts.join(distinct.where(~slotted), F.col(text) == F.col(signature))
    wanted = distinct.where(slotted)
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(signature)), F.lit(0))).first()
    parts = max(-(-n // at_once), -(-size // bytes_at_once))
    for k in range(parts):
        part = [r[0] for r in wanted.where(F.pmod(F.xxhash64(signature), F.lit(parts)) == k).orderBy(signature).collect()]
        out = out.unionByName(slotted_matches(texts, text, signature, part))
    return out
