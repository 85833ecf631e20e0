"""Cases in which rows or values used to be lost, or results to depend on size."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from flowwarden.functions import parsing as G
from flowwarden.functions import values as V
from flowwarden.operators import behavior as B
from flowwarden.operators import features as X
from flowwarden.operators import parse as P
from flowwarden.plans import storage
from flowwarden.plans import training as Tr

HEAD = "<134>1 2025-01-02T03:04:05Z fw1 filterlog 7 - - "
FIELDS = "1,,,5,em1,match,block,in,4,0x0,,64,0,0,DF,6,tcp,40,192.0.2.1,198.51.100.2,4000,443,0,S,1,,100,,"


def test_control_characters_neither_hide_nor_fake_a_header(spark):
    lines = [HEAD + FIELDS, HEAD + FIELDS + "\u0001x\u0002m", "junk \u0001 line", HEAD + FIELDS + "\nmore, text", "", None,
             "\u0001".join(["a"] * 6), HEAD + "1,2,3", HEAD + FIELDS.replace(",4,", ",6,", 1)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, message string")
    accepted = {r.i for r in P.parse_lines(df).collect()}
    rejected = {r.i for r in P.parse_errors(df).collect()}
    assert accepted == {0, 1, 3} and rejected == {2, 4, 5, 6}
    headed = {r.i: r for r in P.parse_header(df).collect()}
    assert headed[1].payload == FIELDS + "\u0001x\u0002m" and headed[3].payload == FIELDS
    assert headed[2].syslog_pri is None and headed[3].raw_message == lines[3]
    relaxed = {r.i: r for r in P.parse_header_relaxed(df).collect()}
    assert relaxed[2].header_form is None and relaxed[1].payload == FIELDS + "\u0001x\u0002m"


def test_text_that_only_starts_like_an_array(spark):
    texts = ["[mss", "[", "[]", "[1]", "[1,2]", "plain", '"[1"', None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in df.select(V.unwrap_json_text(F.col("t"))).collect()]
    assert got == ["[mss", "[", None, "1", "1,2", "plain", '"[1"', None]


def test_encoding_does_not_depend_on_the_vocabulary_size(spark, monkeypatch):
    df = spark.createDataFrame([("block", "tcp", "in"), ("pass", None, "out"), ("pass", "udp", "in")], "action string, proto_name string, dir string")
    vocabulary = X.fit_vocabulary(df, ["action", "proto_name"])
    small = X.encode(df, vocabulary)
    monkeypatch.setattr(X, "MAX_LITERAL_VOCABULARY", 1)
    large = X.encode(df, vocabulary)
    assert small.columns == large.columns == ["action", "proto_name", "dir", "action_encoded", "proto_name_encoded"]
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


def test_kept_model_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "event_id int, length int")
    with pytest.raises(ValueError):
        Tr.fit(df, keep=["length"])


def test_squares_beyond_64_bits(spark):
    """2.2e9 rows at the highest port, as the sums they leave behind."""
    n, port = 2_200_000_000, 65535
    squares = n * port * port
    assert squares > 2 ** 63
    df = spark.createDataFrame([(n, n * port, str(squares))], "c long, s long, q string").select(
        F.col("c").cast(B.WIDE), F.col("s").cast(B.WIDE), F.col("q").cast(B.WIDEST))
    assert df.select(B._sample_std(*[F.sum(x) for x in "csq"])).first()[0] == 0.0
    rows = spark.range(10).select(F.lit("192.0.2.1").alias("src_ip"), F.lit(dt.datetime(2025, 1, 1)).alias("ts"), F.lit(65535).alias("dst_port"))
    assert rows.agg(F.sum((F.col("dst_port").cast("bigint") * F.col("dst_port")).cast(B.WIDE))).first()[0] == 10 * port * port


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())
    Context.master = "local[2]"
    assert storage.shared_folder(Session())


def test_first_line_patterns_agree_with_the_other_engine():
    assert "(?d)" not in G.STRICT_HEADER + G.RELAXED_HEADER + G.BSD_HEADER


@pytest.mark.parametrize("missing", ["ahocorasick", "flowwarden.llm", "corpus_pipeline"])
def test_other_queries_stay_when_the_corpus_operators_cannot_be_imported(missing):
    """A library that only they need, their folder or the pipeline is not there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print('parse_typed' in q, 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["True", "False", "True"]
