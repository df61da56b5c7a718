"""How filters act on each other (11): what each step of every order of five filters removes, by part.

One pass over the texts gives each document five bits; a part is then a tensor of 2 x 2 x 2 x 2 x 2 counts
(axis k: 0 passes filter k, 1 fails it), and each step of each order is a contraction of it that takes pass,
fail or all along every axis.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import SPACE_CLASS, written

LETTERS = "ABCDE"
#: Hash values over which rows without a doc_id are spread.
SPREAD = 1 << 20
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_COUNTS = ["n", "good", "toxic"]


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D of a text that is not null, as booleans: true where the filter fails it."""
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    held = F.when(text.rlike(f"[^{SPACE_CLASS}]"), words).otherwise(F.array().cast("array<string>"))
    sizes = F.struct(F.size(held).alias("words"), F.size(F.array_distinct(held)).alias("kinds"))
    return {
        "A": sizes["words"] < 50,
        "B": sizes["kinds"] * 100 < sizes["words"] * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, A to E (true: fails) and the numbers n, good and toxic of each group of documents that agree in them.

    Texts are read once and never shuffled: a document goes on as a row of its id, part, bits and SHA-256.
    The smallest id of each digest is found by a combined minimum and joined back by digest and id, so copies
    of one text meet in no task. A null text is empty; a null part is the empty string; a null doc_id is larger than all others, and has no
    label. Rows that share a doc_id and a text are copies neither of which is smaller. Of several labels of
    one document the largest count.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    fails = text_failures(F.col("text"))
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("doc_id", "part", *[c.alias(k) for k, c in fails.items()], F.unhex(F.sha2("text", 256)).alias("digest"))
    own = own.withColumn("at", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(-1))
    told = labels.select(labels["doc_id"].alias("of_doc"), labels["quality"].alias("q"), labels["toxic"].alias("t"))
    told = told.filter("of_doc is not null").groupBy("of_doc").agg(F.max((F.col("q") == 1).cast("int")).alias("good"), F.max((F.col("t") == 1).cast("int")).alias("toxic"))
    rows = own.join(told.withColumn("of_at", F.lit(-1).cast("long")), (F.col("doc_id") == F.col("of_doc")) & (F.col("at") == F.col("of_at")), "left")
    keys = ["digest", "doc_id", "part", *"ABCD"]
    rows = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))  # null: no row of this text has an id
    first = first.select(F.col("digest").alias("of_digest"), "first", F.lit(True).alias("is_first"))
    joined = rows.join(first, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    # a text whose ids are all null: none of its rows is smaller than another
    joined = joined.withColumn("E", F.col("is_first").isNull())
    return joined.groupBy("part", *LETTERS).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _selectors() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """All steps (order, step, axis), and for each kind of count what a step takes along each axis: weights of pass and of fail."""
    passes, fails, every = (1, 0), (0, 1), (1, 1)
    steps, taken = [], {k: [] for k in ("kept", "removed", "failing", "unique")}
    for order in permutations(range(5)):
        for k, axis in enumerate(order):
            before = set(order[:k])
            steps.append(("".join(LETTERS[i] for i in order), k + 1, axis))
            taken["kept"].append([passes if i in before or i == axis else every for i in range(5)])
            taken["removed"].append([fails if i == axis else passes if i in before else every for i in range(5)])
            taken["failing"].append([fails if i == axis else every for i in range(5)])
            taken["unique"].append([fails if i == axis else passes for i in range(5)])
    return steps, {k: np.array(v, np.int64) for k, v in taken.items()}


def contracted(tensor: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The sums of a tensor (2 on each of five axes) that rows of weights (n x 5 x 2) select."""
    return np.einsum("abcde,na,nb,nc,nd,ne->n", tensor, *[taken[:, i] for i in range(5)], optimize=True)


def interactions(groups: DataFrame) -> DataFrame:
    """part, filter_order, step and COLUMNS: 600 rows for each part of failures(), zeros included. A part has at most 32 rows."""
    kind = groups.schema["part"].dataType.simpleString()

    def audit(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, taken = _selectors()
        at = tuple(pdf[k].to_numpy(int) for k in LETTERS)
        tensor = {}
        for c in _COUNTS:
            tensor[c] = np.zeros((2,) * 5, np.int64)
            np.add.at(tensor[c], at, pdf[c].to_numpy(np.int64))
        out = pd.DataFrame(steps, columns=["filter_order", "step", "axis"])
        out.insert(0, "part", pdf["part"].iloc[0])
        out["kept"], out["removed"] = contracted(tensor["n"], taken["kept"]), contracted(tensor["n"], taken["removed"])
        out["redundant"] = contracted(tensor["n"], taken["failing"]) - out["removed"]
        out["unique_fails"] = contracted(tensor["n"], taken["unique"])
        out["good_lost"], out["toxic_lost"] = contracted(tensor["good"], taken["removed"]), contracted(tensor["toxic"], taken["removed"])
        out["shapley"] = out.groupby("axis")["removed"].transform("sum")
        return out.drop(columns="axis")

    return groups.groupBy("part").applyInPandas(audit, f"part {kind}, filter_order string, step int, {', '.join(f'{c} long' for c in COLUMNS)}")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """interactions() of failures(). An empty table has no part and no row."""
    return interactions(failures(docs, labels, part, id_col, text_col))
