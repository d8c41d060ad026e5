from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def test_fold_is_fold_py_over_all_code_points(spark):
    """But for code points that this Python does not know yet."""
    known = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    changed = known.withColumn("f", tx.fold(F.col("c"))).where("f <> c").select("id", "f").collect()
    folded = {r.id: r.f for r in changed}
    wrong = []
    for n in range(1, 0x110000):
        c = chr(n)
        if not 0xD800 <= n < 0xE000 and unicodedata.category(c) != "Cn" and folded.get(n, c) != tx.fold_py(c):
            wrong.append(hex(n))
    assert wrong == []


def test_fold_of_texts(spark):
    texts = ["", "ASCII Only", "Pão de LÓ", "ﬁn ½ ＡＢＣ", "한국어 text 한", "\U0001d400\U0001d7d8 x", "ǅ ŀ ﷺ", "é İ ΣΑΣ", None, "ﬁ" * 3000 + "é" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", tx.fold(F.col("t")).alias("f")).collect()
    assert {r.n: r.f for r in rows} == {n: None if t is None else tx.fold_py(t) for n, t in enumerate(texts)}
