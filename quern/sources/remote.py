"""Downloads by tasks: bounded, restartable, and with errors as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(requests: DataFrame, key: str, url: str, folder: str, at_once: int = 12, timeout: float = 60.0, cap: int = 25 * 1024 * 1024) -> DataFrame:
    """(key, path, bytes, sha256, error) of each request.

    ``at_once`` partitions run at most, so at most as many connections are open. A file is
    streamed to a name of its own beside its place and renamed when it is whole, so a task
    that is tried again leaves no half file; a file that is there is not fetched again.
    ``folder`` is one that all executors mount.
    """

    def run(batches):
        import hashlib
        import os
        import urllib.request
        import uuid

        import pandas as pd

        for frame in batches:
            rows = []
            for k, u in zip(frame["key"], frame["url"], strict=True):
                path = os.path.join(folder, str(k).replace("/", "_") + ".fna")
                part = f"{path}.{uuid.uuid4().hex}.part"
                try:
                    if not os.path.exists(path):
                        size = 0
                        with urllib.request.urlopen(u, timeout=timeout) as source, open(part, "wb") as target:
                            while piece := source.read(1 << 20):
                                size += len(piece)
                                if size > cap:
                                    raise ValueError(f"more than {cap} bytes")
                                target.write(piece)
                        if not size:
                            raise ValueError("empty response")
                        os.replace(part, path)
                    digest, size = hashlib.sha256(), os.path.getsize(path)
                    with open(path, "rb") as f:
                        while piece := f.read(1 << 20):
                            digest.update(piece)
                    rows.append((k, path, size, digest.hexdigest(), ""))
                except Exception as e:  # noqa: BLE001 - an error is a result here
                    rows.append((k, None, None, None, f"{type(e).__name__}: {e}"))
                finally:
                    if os.path.exists(part):
                        os.remove(part)
            yield pd.DataFrame(rows, columns=["key", "path", "bytes", "sha256", "error"])

    some = requests.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url")).dropDuplicates(["key"]).repartition(at_once)
    return some.mapInPandas(run, "key string, path string, bytes long, sha256 string, error string").withColumnRenamed("key", key)


def metadata(requests: DataFrame, key: str, url: str, schema: str, at_once: int = 12, timeout: float = 60.0) -> DataFrame:
    """(key, metadata, error): the JSON document at each address, read by ``schema``; errors are rows."""

    def run(batches):
        import urllib.request

        import pandas as pd

        for frame in batches:
            rows = []
            for k, u in zip(frame["key"], frame["url"], strict=True):
                try:
                    ask = urllib.request.Request(u, headers={"Accept": "application/json"}) if u.startswith("http") else u
                    with urllib.request.urlopen(ask, timeout=timeout) as source:
                        rows.append((k, source.read().decode("utf-8"), ""))
                except Exception as e:  # noqa: BLE001 - an error is a result here
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "body", "error"])

    some = requests.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url")).dropDuplicates(["key"]).repartition(at_once)
    got = some.mapInPandas(run, "key string, body string, error string")
    return got.select(F.col("key").alias(key), F.from_json("body", schema).alias("metadata"), "error")
