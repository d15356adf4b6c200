"""CSV gives back every text it was given."""

import random

from rulespan.sources import tables as src


def test_csv_gives_back_every_text(spark, tmp_path):
    rnd = random.Random(4)
    odd = [None, "", " ", "\r\n", "\0,", '\0"', r"\N", r"\\N", "\\N\n", "N", '""', "a,b\n"]
    odd += ["".join(rnd.choices('"\0,\r\n\\N a', k=rnd.randrange(8))) for _ in range(3000)]
    rows = [(i, t, len(t) / 7 if t else None, odd[i % 12]) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "i int, a string, share double, b string")
    src.write_csv(df, f"{tmp_path}/csv")
    back = src.read_csv(spark, f"{tmp_path}/csv", df.schema)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(map(tuple, rows))


def test_the_file_is_plain_csv(spark, tmp_path):
    src.write_csv(spark.createDataFrame([(1, None, ""), (2, 'a "b"', "c")], "i int, a string, b string").coalesce(1), f"{tmp_path}/csv")
    (part,) = tmp_path.glob("csv/part-*")
    assert part.read_text() == 'i,a,b\n1,,""\n2,"a ""b""",c\n'
