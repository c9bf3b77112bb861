"""Label columns. 0 is legitimate, 1 is phishing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_text

# Spellings accepted for each class.
PHISHING_SPELLINGS = ["1", "phishing", "phish", "malicious", "malware", "true", "yes"]
LEGITIMATE_SPELLINGS = ["0", "legitimate", "legit", "ham", "benign", "safe", "false", "no"]


def label_from_text(c: Column) -> Column:
    """Spelled label to 1 / 0; anything else, and null, to null."""
    word = F.lower(strip_text(c))
    return F.when(word.isin(PHISHING_SPELLINGS), 1).when(word.isin(LEGITIMATE_SPELLINGS), 0).cast("int")


def label_from_number(c: Column) -> Column:
    """Numeric label, 0 or 1 only; anything else to null."""
    number = c.try_cast("double")
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def flip_label(c: Column) -> Column:
    """For corpora that code phishing as 0: 1 to 0, 0 to 1, other values to null."""
    return F.when(c == 1, 0).when(c == 0, 1).cast("int")


def label_name(c: Column) -> Column:
    return F.when(c == 0, "LEGITIMATE").when(c == 1, "PHISHING").otherwise("UNKNOWN")


def threshold_label(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def argmax_label(p_legitimate: Column, p_phishing: Column) -> Column:
    """Class of the larger probability; a tie goes to class 0."""
    return F.when(p_phishing > p_legitimate, 1).otherwise(0)
