"""The look in the JVM that decides which texts are examined."""

import random
import re
import time

from pyspark.sql import functions as F

from pliego.llm import encoding


def test_needs_look(spark):
    """The pattern says what its alternatives say one by one, and looks through clean text about as fast as a plain one."""
    upper, lower = "".join(c for c in encoding.CLEAN if c.isupper()), "".join(c for c in encoding.CLEAN if c.islower())
    plain = re.compile(f"[^\x00-\x7f{encoding.CLEAN}¿«»ºª“”…€]|[^\x00-\x7f]{{2}}|[a-z{lower}][{upper}]|[A-Z{upper}]{{2}}[{lower}]")
    rng = random.Random(4)
    texts = ["".join(rng.choices("aaaaaaBBBBBBcccccDDDDD" + "aBcD .\náéÁÉñ¿«ºÃ©�😀", k=rng.randint(0, 9))) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(encoding.needs_look(F.col("t"))).collect()]
    assert got == [plain.search(t) is not None for t in texts]
    long = spark.range(1).select(F.repeat(F.lit("La renta del contrato se paga cada mes, según la ley. "), 60_000).alias("t")).persist()
    long.count()

    def took(c):
        began = time.time()
        long.where(c).count()
        return time.time() - began

    assert min(took(encoding.needs_look(F.col("t"))) for _ in range(3)) < 5 * min(took(F.col("t").rlike("[^\\x00-\\x7F][^\\x00-\\x7F]")) for _ in range(3)) + 0.5
