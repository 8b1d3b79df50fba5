"""Cost estimate for external extraction and classification of mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine import rules
from tripmine.functions.prompts import prompt, prompt_chars


def estimate(mail: DataFrame, **settings) -> DataFrame:
    """One row: mails, tokens, costs and averages. Settings as in a task of
    :func:`estimate_by_task`."""
    return estimate_by_task(mail, {"": settings}).drop("label")


def estimate_by_task(mail: DataFrame, tasks: dict[str, dict]) -> DataFrame:
    """Estimates of several tasks, one labelled row each, from one pass that
    reads nothing of the mail but text lengths.

    A task may set ``input_rate`` and ``output_rate`` (per million tokens;
    costs are null unless both are given), ``output_tokens`` and
    ``overhead_tokens`` per mail and ``max_body_chars``.
    """
    sums, rows = [F.count("*").alias("email_count")], []
    for i, (label, task) in enumerate(tasks.items()):
        cap = task.get("max_body_chars")
        tokens = F.ceil(prompt_chars(max_body_chars=cap) / rules.CHARS_PER_TOKEN).cast("bigint")
        overhead = max(task.get("overhead_tokens", rules.PROMPT_OVERHEAD_TOKENS), 0)
        sums.append(F.coalesce(F.sum(tokens + overhead), F.lit(0).cast("bigint")).alias(f"in{i}"))
        output = max(task.get("output_tokens", rules.OUTPUT_TOKENS_EXTRACTION), 0)
        rates = task.get("input_rate"), task.get("output_rate")
        priced = None not in rates
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                F.col("email_count"),
                F.col(f"in{i}").alias("total_input_tokens"),
                (F.col("email_count") * F.lit(output).cast("bigint")).alias("total_output_tokens"),
                F.lit(float(rates[0]) if priced else None).cast("double").alias("input_rate"),
                F.lit(float(rates[1]) if priced else None).cast("double").alias("output_rate"),
                F.lit(cap).cast("bigint").alias("max_body_chars"),
            )
        )
    count = F.col("email_count")

    def cost(kind: str):
        return F.col(f"total_{kind}_tokens") / F.lit(1_000_000.0) * F.col(f"{kind}_rate")

    def average(total: str):
        # No mail gives 0; an unknown cost stays null.
        per_mail = F.try_divide(F.col(total).cast("double"), count)
        return F.when((count == 0) & F.col(total).isNotNull(), 0.0).otherwise(per_mail)

    return (
        mail.agg(*sums)
        .select(F.inline(F.array(*rows)))
        .withColumns({"input_cost": cost("input"), "output_cost": cost("output")})
        .withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
        .select(
            "label",
            "email_count",
            "total_input_tokens",
            "total_output_tokens",
            "input_cost",
            "output_cost",
            "total_cost",
            average("total_input_tokens").alias("avg_input_tokens"),
            average("total_output_tokens").alias("avg_output_tokens"),
            average("total_cost").alias("avg_cost"),
            F.when(count == 0, "approx")
            .otherwise(f"approx:{rules.CHARS_PER_TOKEN}chars")
            .alias("tokenizer"),
            "max_body_chars",
        )
    )


def requests(mail: DataFrame, tasks: dict[str, int | None]) -> DataFrame:
    """Request table ``(email_id, task, prompt)`` an external job can work off.

    ``tasks`` maps ``extraction`` / ``classification`` to its body cap. The
    mail is read once; each row is then spread over the tasks.
    """
    heads = {
        "extraction": rules.EXTRACTION_PROMPT_HEAD,
        "classification": rules.CLASSIFICATION_PROMPT_HEAD,
    }
    items = [
        F.struct(F.lit(task).alias("task"), prompt(heads[task], cap).alias("prompt"))
        for task, cap in tasks.items()
    ]
    return mail.select(F.col("id").alias("email_id"), F.inline(F.array(*items)))
