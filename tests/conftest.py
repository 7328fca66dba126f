import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def streamed(spark, tmp_path):
    folder = str(tmp_path)

    def run(df, make, name, parts=3, by="us"):
        """What a stream gives for rows that come in several files, in order of `by`."""
        rows = df.orderBy(by).collect()
        step = -(-len(rows) // parts)
        for k in range(parts):
            if part := rows[k * step : (k + 1) * step]:
                spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    return run
