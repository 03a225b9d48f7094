"""The codecs inside Spark's JVM: Codecs.java, compiled by the compiler that Spark brings, and sent to the executors."""

from __future__ import annotations

import logging
import os
import tempfile
import zipfile
from importlib import resources
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: by application: the function, or None where it can't be made
_made: dict[str, Any] = {}


def _make(spark: SparkSession) -> Any:
    source = resources.files("treeframe.functions").joinpath("Codecs.java").read_text()
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    jar = os.path.join(tempfile.mkdtemp(prefix="treeframe-"), "treeframe-codecs.jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    spark.sparkContext._jsc.addJar(jar)
    own = compiler.getClassLoader().loadClass("treeframe.Codecs")
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson('"binary"')
    # udf has an overload for any object, too, which Spark refuses; by name alone, Py4J takes now the one, now the other
    named = jvm.java.lang.Class.forName
    types = _array(spark, jvm.java.lang.Class, named("org.apache.spark.sql.api.java.UDF3"), named("org.apache.spark.sql.types.DataType"))
    method = named("org.apache.spark.sql.functions").getMethod("udf", types)
    return method.invoke(None, _array(spark, jvm.java.lang.Object, own.newInstance(), kind))


def _array(spark: SparkSession, kind: Any, *items: Any) -> Any:
    out = spark.sparkContext._gateway.new_array(kind, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out


def _function(spark: SparkSession) -> Any:
    if not hasattr(spark, "_jvm"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _made:
        try:
            _made[app] = _make(spark)
        except Exception:
            log.warning("codecs can't be compiled in this JVM; those in Python are used", exc_info=True)
            _made[app] = None
    return _made[app]


def available(spark: SparkSession) -> bool:
    return _function(spark) is not None


def run(spark: SparkSession, data: Column, steps: Column, forward: bool) -> Column:
    """The binary column after the codecs that steps names, with commas between them; backwards unless forward."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    return Classic(_function(spark).apply(_to_seq(spark.sparkContext, [data, steps, F.lit(forward)], _to_java_column)))
