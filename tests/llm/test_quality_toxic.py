"""The query's verdict on documents with toxic words: planted ones and the table's own go, clean ones stay."""

import random

from pyspark.sql import functions as F

from corpusloom.llm import quality_rules
from corpusloom.llm.queries import QUERIES

D = "/root/testdata/sf0.01"


def test_planted_toxic_go_and_clean_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("an", "be", "co", "er", "fi", "ga")) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(40, 1500))]
        if i % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(("Vermin,", "vermin", "filth.", "FILTH"))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.score_quality(docs, labels, reject_toxic=True).filter("kept").collect()}
    assert not [i for i in kept if i % 6 == 0] and len([i for i in range(600) if i % 6 and i not in kept]) <= 2
    assert quality_rules.score_quality(docs, labels.filter("toxic = 0"), reject_toxic=True).filter("kept = base_failed").count() == 0
    assert quality_rules.score_quality(docs.limit(0), labels, reject_toxic=True).count() == 0


def test_query_rejects_toxic_words(spark):
    labels, docs = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("labels", "documents"))
    judged = QUERIES["op4_quality_rules"](spark, D).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").filter("not base_failed and (quality = 1 or quality is null)")
    worded = F.lower("text").rlike(r"\b(trash|pathetic|idiot|disgusting|worthless|clown|loser|scum|stupid|moron)\b")
    print([(r.w, r.toxic, r.kept, r["count"]) for r in judged.groupBy(worded.alias("w"), "toxic", "kept").count().collect()])
    assert judged.filter(worded).count() > 30 and judged.filter(worded & F.col("kept")).count() == 0
    assert judged.filter("toxic = 0 and not kept").count() <= 1
