"""What near-duplicate search leaves on disk while it runs."""

import time
from pathlib import Path

from lakeloom.llm import near_duplicates

WORDS = [f"слово{i}" for i in range(40)]
TEXTS = [" ".join(WORDS[k : k + 20]) for k in (0, 1, 20)] + [" ".join(WORDS[:20])]


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


def test_shuffles_of_a_stage_are_gone_before_the_next(spark, monkeypatch):
    before, left, plain = shuffle_files(spark), {}, near_duplicates.stage

    def staged(df, name, **options):
        found, until = plain(df, name, **options), time.time() + 5
        while (files := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        left[name] = len(files)
        return found

    monkeypatch.setattr(near_duplicates, "stage", staged)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting, None)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").repartition(4)
    got = {r.id: r.group_id for r in near_duplicates.near_duplicate_groups(df, "id", "t").collect()}
    assert got == {0: 0, 1: 0, 3: 0}
    assert left.keys() >= {"classes", "pairs", "likely", "texts", "links"} and not any(left.values()), left
    assert spark.conf.get(setting, None) == kept


def test_keys_of_all_bands_are_shuffled_in_rounds(spark, monkeypatch):
    rounds, plain = [], near_duplicates._pairs
    monkeypatch.setattr(near_duplicates, "_pairs", lambda keyed, share: rounds.append({(r.key, r.rep) for r in keyed.collect()}) or plain(keyed, share))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    near_duplicates.near_duplicate_groups(df, "id", "t")
    assert len(set().union(*rounds)) == 3 * near_duplicates.BANDS
    assert max(map(len, rounds)) <= 3 * near_duplicates.BANDS / 2
