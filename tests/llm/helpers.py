"""Small documents that hold every odd case."""

from __future__ import annotations

import contextlib
import os
import random

from hardwood.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "sto") for b in ("n", "t", "ria", "vo", "")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((3, 25, 60)))]
        rows.append((i, " ".join(words) + ".", "en" if i % 3 else "fr", f"s{i % 3}", None))
    text = rows[5][1]
    rows += [(100, text, "en", "s0", 1), (101, text.upper(), "en", None, 1), (101, text.upper(), "en", None, 1), (102, text + " one more word", "en", "s1", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n ", "en", "s1", 3), (203, "one", "en", "s1", 3), (204, "One two", "en", "s2", 3), (None, text, "en", "s1", 1), (None, None, None, None, None)]
    rows += [(300, "x " * 6000 + "end", "en", "s2", 1), (301, "y" * 3000, "en", "s2", 1), (302, "日本語 текст　ü\n\nline\nline\nline", "ja", "s2", 1)]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def tables(spark, folder, **frames):
    """Writes frames as <folder>/<name>.parquet and returns the folder."""
    for name, df in frames.items():
        df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@contextlib.contextmanager
def many_partitions(spark, n):
    """Shuffles of n partitions, none of which are merged."""
    settings = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def files_written(monkeypatch):
    """Gets the number of files of each table that a scratch keeps from now on."""
    counts, keep = {}, Scratch.keep

    def counted(self, df, name, *args, **more):
        kept = keep(self, df, name, *args, **more)
        path = kept._hardwood_path
        counts[path.rsplit("/", 1)[1]] = sum(f.endswith(".parquet") for f in os.listdir(path.removeprefix("file://")))
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    return counts
