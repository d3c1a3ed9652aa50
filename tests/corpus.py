"""The small corpora that the search tests share."""

from pyspark.sql import functions as F

from lexweave.operators.index import FieldSpec, build_index
from lexweave.plans.search import Index

#: The documents whose scores and interchange text are given.
GREEN = [
    ("a", "Mr. Green kills Colonel Mustard", "Mr. Green killed Colonel Mustard in the study with the candlestick. Mr. Green is not a very nice fellow.", 19),
    ("b", "Plumb waters plant", "Professor Plumb has a green plant in his study", 9),
    ("c", "Scarlett helps Professor", "Miss Scarlett watered Professor Plumbs green plant while he was away from his office last week.", 16),
]
SCRIPT = ("d", "All about JavaScript", "JavaScript objects have a special __proto__ property", 7)


def frame(spark, rows=GREEN):
    return spark.createDataFrame(rows, "id string, title string, body string, words int")


def green_index(spark, title=1.0, body=10.0, rows=GREEN, **options):
    fields = [FieldSpec("title", title), FieldSpec("body", body)]
    return Index(build_index(frame(spark, rows), "id", fields, order=F.ascii("id"), **options))


def results(df):
    return [(r["doc_ref"], round(r["score"], 6)) for r in df.collect()]
