"""Prompt and verdict columns for an external language model. The call itself is not part of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS_CLASS, strip_text

# Wording of the prompt.
PROMPT_LINES = [
    "",
    "    You are an expert in phishing email detection.",
    "",
    "    Analyze the following email and respond in this JSON format:",
    "    {",
    '    "is_phishing": true or false,',
    '    "explanation": "A short explanation of why you classified it that way."',
    "    }",
    "",
    "    Email:",
]
PARSE_ERROR = "Failed to parse model response"


def verdict_prompt(subject: Column, body: Column, sender: Column | None = None) -> Column:
    """Prompt for one e-mail; the sender line is left out when no sender is given. A missing part reads None."""

    def line(tag: str, value: Column) -> list[Column]:
        return [F.lit(f"    {tag}: "), F.coalesce(value, F.lit("None")), F.lit("\n")]

    parts = [F.lit("\n".join(PROMPT_LINES) + "\n"), *line("Subject", subject)]
    if sender is not None:
        parts += line("From", sender)
    return F.concat(*parts, *line("Body", body), F.lit("    "))


def strip_fence(response: Column, mode: str = "live") -> Column:
    """Response without a Markdown code fence.

    ``live`` removes the opening fence with its optional ``json`` tag and the closing fence. ``test`` removes
    backticks at both ends and then the first line, whatever it holds, if there are several.
    """
    text = strip_text(response)
    if mode == "live":
        fence = rf"\A```(?:json)?[{WS_CLASS}]*|[{WS_CLASS}]*```\z"
        bare = F.regexp_replace(text, fence, "")
    else:
        inner = strip_text(F.btrim(text, F.lit("`")))
        newline = F.instr(inner, "\n")
        bare = F.when(newline > 0, F.substring(inner, newline + 1, F.length(inner))).otherwise(inner)
    return F.when(text.startswith("```"), bare).otherwise(text)


def with_verdict(df: DataFrame, response: str = "response", mode: str = "live") -> DataFrame:
    """``df`` plus ``is_phishing``, ``flag``, ``explanation``, ``error``, ``raw_response`` and ``predicted``.

    Anything that is not a JSON object is an error and keeps the raw response; so are a repeated key and ``NaN``. A
    missing key is null, not an error. ``flag`` is the JSON text of the answer as given, ``is_phishing`` the same as a
    boolean where it is one. ``predicted`` is 1 when the value under ``is_phishing`` is neither null, false, zero nor empty.
    """
    step = df.withColumn("_v", F.try_parse_json(strip_fence(F.col(response), mode)))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    step = step.withColumn("_v", F.when(is_object, F.col("_v")))
    failed = F.col("_v").isNull()
    flag_json = F.to_json(F.try_variant_get("_v", "$.is_phishing", "variant"))
    falsy = flag_json.isin("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")
    predicted = F.when(failed, F.lit(None).cast("int")).when(flag_json.isNull() | falsy, 0).otherwise(1)
    return step.withColumns(
        {
            "is_phishing": F.try_variant_get("_v", "$.is_phishing", "boolean"),
            "flag": flag_json,
            "explanation": F.try_variant_get("_v", "$.explanation", "string"),
            "error": F.when(failed, PARSE_ERROR),
            "raw_response": F.when(failed, F.col(response)),
            "predicted": predicted,
        }
    ).drop("_v")
