"""Text and vector helpers: lexicon mood, extraction, chunking, hashed embeddings, cosine search."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def mood(df: DataFrame, text: str, up: list[str], down: list[str], negations: list[str], flips: list[str] | None = None) -> DataFrame:
    """``mood``: (ups - downs) / (ups + downs + 1), held to +-0.9; a word after a negation counts for the other
    side, and a text that holds a flipping phrase is turned."""
    lit = lambda ws: F.array(*(F.lit(w) for w in ws))
    start = F.struct(F.lit(0).alias("ups"), F.lit(0).alias("downs"), F.lit(False).alias("negated"))

    def step(a: Column, w: Column) -> Column:
        good, bad = F.array_contains(lit(up), w), F.array_contains(lit(down), w)
        rise, fall = (good & ~a["negated"]) | (bad & a["negated"]), (bad & ~a["negated"]) | (good & a["negated"])
        return F.struct((a["ups"] + rise.cast("int")).alias("ups"), (a["downs"] + fall.cast("int")).alias("downs"), F.array_contains(lit(negations), w).alias("negated"))

    # one fold over the words, which are found once; the optimiser keeps it apart as its result is used twice
    rows = df.withColumn("__mood", F.aggregate(words(text), start, step))
    rows = rows.withColumn("ups", F.col("__mood.ups")).withColumn("downs", F.col("__mood.downs")).drop("__mood")
    ups, downs = F.col("ups"), F.col("downs")
    score = (ups - downs) / (ups + downs + 1)
    if flips:
        turned = F.lit(False)
        for phrase in flips:
            turned = turned | F.contains(F.lower(F.col(text)), F.lit(phrase))
        score = F.when(turned, -score).otherwise(score)
    return rows.withColumn("mood", F.least(F.greatest(score, F.lit(-0.9)), F.lit(0.9)))


def entities(df: DataFrame, text: str) -> DataFrame:
    """Six-digit codes, mail addresses and amounts in a text, as arrays."""
    find = lambda pattern: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return df.withColumn("codes", find(r"(?<![0-9])([0-9]{6})(?![0-9])")).withColumn("mails", find(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})")).withColumn("amounts", find(r"\$([0-9]+(?:\.[0-9]+)?)"))


def chunks(df: DataFrame, text: str, keep: list[str], most: int = 400) -> DataFrame:
    """Paragraphs (parted by blank lines) packed in order into chunks of at most ``most`` characters, line ends
    between them not counted; a longer paragraph is a chunk of its own. Rows: ``keep``, chunk_no, chunk."""
    bare = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), bare), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, p: Column) -> Column:
        fits = (F.length(a["open"]) == 0) | (F.length(a["open"]) + F.length(p) <= most)
        joined = F.when(F.length(a["open"]) == 0, p).otherwise(F.concat(a["open"], F.lit("\n"), p))
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    packed = F.aggregate(parts, start, add, lambda a: F.when(F.length(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return df.select(*keep, F.posexplode(packed).alias("chunk_no", "chunk"))


def trigram_embedding(text: Column | str, dim: int = 256) -> Column:
    """Unit vector of hashed character trigrams: lower case, runs of white space as one space; of an 8-byte
    BLAKE2b, which Spark doesn't have, the first four bytes name the bucket and the fifth's lowest bit the sign.
    Shorter texts have a zero vector."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        clean = texts.fillna("").str.lower().str.replace(r"\s+", " ", regex=True)
        letters = np.array(list("".join(clean)), dtype="U1")
        ends = np.cumsum(clean.str.len().to_numpy(), dtype=np.int64)
        owner = np.repeat(np.arange(len(clean)), np.diff(ends, prepend=0))
        starts = np.flatnonzero(owner[2:] == owner[:-2]) if len(letters) > 2 else np.zeros(0, np.int64)
        grams, which = np.unique(np.char.add(np.char.add(letters[starts], letters[starts + 1]), letters[starts + 2]), return_inverse=True)
        digests = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams.tolist()), np.uint8).reshape(-1, 8)
        bucket = (digests[:, :4].astype(np.int64) << np.array([0, 8, 16, 24])).sum(1) % dim
        sign = np.where(digests[:, 4] & 1, 1.0, -1.0)
        out = np.zeros((len(clean), dim))
        np.add.at(out, (owner[starts], bucket[which]), sign[which])
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(size > 0, size, 1.0)), index=texts.index)

    return embed(F.col(text) if isinstance(text, str) else text)


def report_date(path: Column | str) -> Column:
    """The date that a path or file name holds: year, month and day apart by slashes or their signs; eight digits
    or dashed; six digits of this century. The first form that is a date counts; missing if none is."""
    c = F.col(path) if isinstance(path, str) else path
    forms = (
        (r"(?:^|[^0-9])([0-9]{4})[年/]([0-9]{1,2})[月/]([0-9]{1,2})(?:[^0-9]|$)", ""),
        (r"(?:^|[^0-9])(20[0-9]{2})[-_]?([0-9]{2})[-_]?([0-9]{2})(?:[^0-9]|$)", ""),
        (r"(?:^|[^0-9])(2[0-9])(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)", "20"),
    )
    found = []
    for pattern, century in forms:
        year, month, day = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
        y, m, d = F.concat(F.lit(century), year).try_cast("int"), month.try_cast("int"), day.try_cast("int")
        found.append(F.when(y.between(2000, 2099) & m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d)))
    return F.coalesce(*found)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def cosine_top_k(df: DataFrame, query: DataFrame, k: int, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """The k rows nearest to one query vector (one row); ties by id."""
    one = query.select(F.col(vector).alias("__q")).limit(1)
    rows = df.crossJoin(F.broadcast(one)).select(row_id, cosine(F.col(vector), F.col("__q")).alias("score"))
    return rows.orderBy(F.desc("score"), row_id).limit(k)


def keyword_score(df: DataFrame, text: str, question: str) -> DataFrame:
    """How many of the question's words (two letters and more) a text holds."""
    asked = sorted({w for w in question.lower().split() if len(w) >= 2})
    return df.withColumn("hits", F.size(F.filter(F.array(*(F.lit(w) for w in asked)), lambda w: F.contains(F.lower(F.col(text)), w))))
