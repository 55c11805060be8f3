"""Judging answers: a judge is any function from prompts to replies; replies are asked for again until they can be read, and logged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import filled, rubric_direction, tolerant_json

#: A judge: replies to some prompts, in order. It runs in the workers, so that it must be sent there.
Judge = Callable[[list[str]], list[str]]
REMINDER = "\n只返回 JSON。"
JUDGES: dict[str, Callable[..., Judge]] = {}


def judge(name: str) -> Callable[[Callable[..., Judge]], Callable[..., Judge]]:
    def add(make: Callable[..., Judge]) -> Callable[..., Judge]:
        JUDGES[name] = make
        return make

    return add


@judge("offline")
def offline(share: int = 2) -> Judge:
    """A stand-in without a model: a criterion is met if its prompt's length can be divided; every third reply is only readable when reminded."""

    def replies(prompts: list[str]) -> list[str]:
        said = []
        for p in prompts:
            bare = p.removesuffix(REMINDER)
            met = "true" if len(bare) % share == 0 else "false"
            said.append("no idea" if len(bare) % 3 == 0 and p == bare else f'```json\n{{"criteria_met": {met},}}\n```')
        return said

    return replies


def prompts(cases: DataFrame, template: str) -> DataFrame:
    """(case_id, k, dimension, point, prompt) for each criterion of cases (case_id, question, answer, rubrics)."""
    each = cases.select("case_id", "question", "answer", F.posexplode("rubrics").alias("k", "r"))
    text = filled(template, question=F.col("question"), answer=F.col("answer"), criterion=F.col("r.criterion"), direction=rubric_direction(F.col("r.point")))
    return each.select("case_id", "k", F.col("r.dimension").alias("dimension"), F.col("r.point").alias("point"), text.alias("prompt"))


def judged(asked: DataFrame, name: str, made: Judge, tries: int = 2) -> DataFrame:
    """asked with judge, reply, met and ok: a reply that holds no JSON is asked for again, with a reminder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = made(batch["prompt"].tolist())
            for _ in range(tries - 1):
                again = [i for i, r in enumerate(replies) if "{" not in r]
                for i, r in zip(again, made([batch["prompt"].iloc[i] + REMINDER for i in again]) if again else [], strict=True):
                    replies[i] = r
            yield batch.assign(reply=replies)

    x = asked.mapInPandas(run, T.StructType([*asked.schema.fields, T.StructField("reply", T.StringType())])).withColumn("judge", F.lit(name))
    met = F.try_variant_get(tolerant_json(F.col("reply")), "$.criteria_met", "boolean")
    return x.select("*", F.coalesce(met, F.lit(False)).alias("met"), met.isNotNull().alias("ok"))
