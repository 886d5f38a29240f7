"""Sources asked one after the other, each for the keys that are still unanswered.

What is left is counted before a source is read. A few keys go into the scan as literals, where files and row groups without them are
skipped; more go through a semi-join, for which Spark chooses a broadcast below its limit and a runtime filter above. Answers
are written, so a source is read once and a lost executor asks none again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.folders import stage

#: Keys that go into a scan as literals.
LITERAL_KEYS = 1000


def asked(source: DataFrame, left: DataFrame, key: str, literal: int = LITERAL_KEYS) -> DataFrame:
    """The rows of ``source`` whose key is in ``left`` (distinct keys)."""
    few = left.select(key).limit(literal + 1).collect()
    if len(few) <= literal:
        return source.where(F.col(key).isin([r[0] for r in few]))
    return source.join(left.select(key), key, "left_semi")


def cascade(wanted: DataFrame, key: str, sources: list[tuple[str, DataFrame]], answers: Column, reason: str, literal: int = LITERAL_KEYS) -> DataFrame:
    """A row a distinct key of ``wanted``: key, source, attempts (names in the order asked, the answering one last), reason, answer.

    Sources have the key and at most one row a key, and the same columns; a row answers where ``answers`` holds. A key that none answers has no
    source and no answer, and its reason names what was asked. Null keys are not asked.
    """
    columns = [c for c in sources[0][1].columns if c != key]
    answer = F.struct(*columns)
    left = stage(wanted.select(key).where(F.col(key).isNotNull()).distinct(), "asked")
    out, names = None, []
    for name, source in sources:
        names.append(name)
        found = stage(asked(source, left, key, literal).where(answers).select(key, answer.alias("answer")), f"answers-{len(names)}")
        row = found.select(key, F.lit(name).alias("source"), F.array(*map(F.lit, names)).alias("attempts"), F.lit(None).cast("string").alias("reason"), "answer")
        out = row if out is None else out.unionByName(row)
        left = stage(left.join(found.select(key), key, "left_anti"), "left")
    why = F.lit(f"{reason}; attempted sources: {', '.join(names)}")
    return out.unionByName(left.select(key, F.lit(None).cast("string").alias("source"), F.array(*map(F.lit, names)).alias("attempts"), why.alias("reason"), F.lit(None).cast(out.schema["answer"].dataType).alias("answer")))
