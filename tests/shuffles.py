"""What a query shuffles, as Spark's own store of stages counts it."""

from pyspark.sql import DataFrame, SparkSession


def shuffled(spark: SparkSession, frame: DataFrame) -> int:
    """Bytes that the stages of one run of ``frame`` write for others."""
    context = spark.sparkContext
    jvm, inner = context._jvm, context._jsc.sc()

    def written() -> dict[int, int]:
        inner.listenerBus().waitUntilEmpty(60_000)
        stages = inner.statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    frame.write.format("noop").mode("overwrite").save()
    return sum(v for k, v in written().items() if k not in before)
