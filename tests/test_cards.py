from pyspark.sql import functions as F

from spindrift.sources import cards


def test_every_card_of_a_page_is_read(spark):
    page = "".join(f'<a data-jk="{i}"><span title="Job {i}">x</span></a>' for i in range(10_005))
    rows = spark.createDataFrame([(page,), ("none",), (None,)], "html string")
    assert cards.keyed_cards(rows, F.lit("2026-03-05").cast("date")).count() == 10_005
