import io
import wave

import pytest
from pyspark.sql import functions as F

from verbatik.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_output_plan(spark):
    plan = lambda form, path, encoder: tuple(one(spark, sinks.output_plan(F.lit(form), F.lit(path).cast("string"), F.lit(encoder))))
    assert plan("auto", None, True) == ("out.m4a", True)
    assert plan("auto", None, False) == ("out.wav", False)
    assert plan("auto", "a.WAV", True) == ("a.WAV", False)
    assert plan("m4a", "a", False) == ("a", True)
    with pytest.raises(Exception, match="contradicts"):
        plan("wav", "a.m4a", True)


def test_markdown_row(spark):
    row = sinks.markdown_row([(F.lit(1.234), 2), (F.lit(None).cast("double"), 1)], [F.lit("m")], F.lit("a|b\nc"))
    assert one(spark, row) == "| m | 1.23 | — | a\\|b c |"


def test_wav(spark):
    data = one(spark, sinks.wav_bytes(F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)), 24000))
    with wave.open(io.BytesIO(bytes(data))) as w:
        assert (w.getnframes(), w.getframerate(), w.getsampwidth()) == (3, 24000, 2)
        assert w.readframes(3) == b"\x00\x00\xff\x3f\xff\x7f"
