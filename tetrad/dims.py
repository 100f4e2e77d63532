"""Small fixed dimensions: the 16 classes and the class priors.

Both are bounded by definition (16 rows, 32 rows), so they are built with
``createDataFrame`` on the driver and always joined with ``broadcast``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the reference's) -----------------------------
# Class names in index order. Letters from the left are the axes
# I/E, N/S, T/F, J/P; index bits from the left select the second letter.
CLASS_NAMES = [
    "intj", "intp", "infj", "infp",
    "istj", "istp", "isfj", "isfp",
    "entj", "entp", "enfj", "enfp",
    "estj", "estp", "esfj", "esfp",
]
# Real-world class prior used for the proportional variant.
PRIOR_PROPORTIONAL = {
    "ISFJ": 0.0908, "ISTJ": 0.0889, "INFP": 0.0807, "INFJ": 0.0768,
    "ENFP": 0.0736, "ISFP": 0.0713, "ENFJ": 0.0661, "ESFJ": 0.0631,
    "ESTJ": 0.0611, "ISTP": 0.0537, "INTJ": 0.0597, "ESFP": 0.0521,
    "INTP": 0.0492, "ENTJ": 0.0487, "ENTP": 0.0361, "ESTP": 0.0281,
}
# Uniform prior used for the balanced variant.
PRIOR_BALANCED = {name.upper(): 0.0625 for name in CLASS_NAMES}
# Special tokens of the vocabulary.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
# Training prompt: instruction header, one worked example, then the post.
# The indentation of the continuation lines is a parameter (12 spaces in
# training, 8 in the one-record CLI).
PROMPT_EXAMPLE = (
    "know intj tool use interaction people excuse antisocial truly enlighten mastermind "
    "know would count pet peeze something time matter people either whether group people "
    "mall never see best friend sit outside conversation jsut listen want interject sit "
    "formulate say wait inject argument thought find fascinate sit watch people talk people "
    "fascinate sit class watch different people find intrigue dad intj u stand look like "
    "line safeway watch people home talk people like think military job people voluntarily "
    "go job important show deference endanger live glorify way civilian think pretty "
    "ignorant general think military necessary defense mechanism political tactic feel like "
    "u specifically invest much money could put money education whatnot though personally "
    "sound budget aernative really comment one way base two politician eye year ago come "
    "name somewhat important kinda role model nowadays pick keep score individual level "
    "mean little vary accord number condition day may score high others low sweat really "
    "good cast physiotherapist like fiberglass cast break arm whatever sometimes want take "
    "picture beast put someone arm sadly people blind brilliance need tell directly wave arm "
    "frantically totally beyond oblivious get good eye contact help lot start find like "
    "attention get opposite sex notice however gay men tend little aggressive always walk "
    "away flatter like alcohol bad start generally keep go pas run money even mention fact "
    "crave cocaine drink political power mainly desire form power okay status still never "
    "study day life never learn study feel like real whatever reason college prepare "
    "recieve people like depend career introductory course help start rid bike write essay "
    "etc choose career least stimulate mind expand perspective reality without college like "
    "kiss sound ear yup roll end quite strange confession time mind wish people le "
    "judgemental self perceive flaw run situation person confess something expect judge one "
    "way another freak realize"
)
ANSWER_MARK = "[MBTI]"
END_MARK = "<|endoftext|>"
IGNORE_INDEX = -100
# Word limits: plain input keeps max_length-10, prompted input max_length//2,
# generation prompt 300 words; max_length is 512.
MAX_LENGTH = 512
TOKEN_LIMIT = 510
# ---------------------------------------------------------------------------


def instruction(indent: int = 12) -> str:
    """The one-shot instruction placed before a post (prompt P7)."""
    pad = " " * indent
    return (f"## Instruction: Classify the {ANSWER_MARK} of the given [Text].\n"
            f"{pad}[Text]\n{pad}{PROMPT_EXAMPLE}\n{pad}{ANSWER_MARK}\n{pad}intj\n"
            f"{pad}[Text]\n{pad}")


def class_bits(idx: int) -> str:
    return format(idx, "04b")


def classes(spark: SparkSession) -> DataFrame:
    """``classes(idx INT, name STRING, bits STRING)``, 16 rows."""
    schema = T.StructType([
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("bits", T.StringType(), False),
    ])
    rows = [(i, n, class_bits(i)) for i, n in enumerate(CLASS_NAMES)]
    return spark.createDataFrame(rows, schema)


def priors(spark: SparkSession, variant: str | None = None) -> DataFrame:
    """``priors(variant STRING, type STRING, real_frac DOUBLE)``."""
    schema = T.StructType([
        T.StructField("variant", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("real_frac", T.DoubleType(), False),
    ])
    rows = [("prop", t, float(f)) for t, f in PRIOR_PROPORTIONAL.items()]
    rows += [("bal", t, float(f)) for t, f in PRIOR_BALANCED.items()]
    df = spark.createDataFrame(rows, schema)
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    return df


def class_name_array():
    """The class names as an array literal, index i at position i+1."""
    return F.array(*[F.lit(n) for n in CLASS_NAMES])
