"""Regular expressions as the JVM reads them, since it is the JVM that runs them."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException


def regex_error(pattern: str) -> str | None:
    """Why java.util.regex refuses a pattern, if it does. Without a running session, by Python's own reading."""
    sc = SparkContext._active_spark_context
    try:
        if sc is None:
            re.compile(pattern)
        else:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
    except re.error as e:
        return str(e)
    except (Py4JJavaError, PySparkException) as e:
        return str(e).split("\n")[0]
    return None
