"""Where the files of a lake lie: from a path as Spark names it to the store that opens it in a task.

Spark lists files with the cluster's own file systems and names them by plain text: ``scheme://authority/path`` or ``scheme:/path``, with
blanks and percent signs as they are. Tasks have no access to those file systems, so a path is opened with the store of the same
kind here, which is given the credentials that the cluster's configuration holds for it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import SparkSession

_URL = re.compile(r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*):(?://(?P<authority>[^/]*))?(?P<path>/?.*)", re.S)
#: Configuration that tasks need, by the beginning of its keys (fixed values).
PREFIXES = ("fs.s3a.", "fs.azure.")
#: Arguments of a store of S3 by key behind fs.s3a. or fs.s3a.bucket.<bucket>. (fixed values).
_S3 = {"access.key": "access_key", "secret.key": "secret_key", "session.token": "session_token", "endpoint": "endpoint_override", "endpoint.region": "region"}


def options(spark: SparkSession) -> dict[str, str]:
    """The cluster's file system settings that stores() understands."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    found = {before + k: v for before in PREFIXES for k, v in dict(conf.getPropsWithPrefix(before)).items()}
    return found | {"fs.defaultFS": conf.get("fs.defaultFS") or "file:///"}


def located(file: str, mounts: dict[str, str] | None = None) -> tuple[str, str, str]:
    """Scheme, authority and path of a file. mounts: beginnings of names, and what stands for them; the longest one counts."""
    for begin in sorted(mounts or {}, key=len, reverse=True):
        if file.startswith(begin):
            file = mounts[begin] + file[len(begin) :]
            break
    m = _URL.fullmatch(file)
    if m is None:
        return "file", "", file
    return m["scheme"].lower(), m["authority"] or "", m["path"]


def arguments(scheme: str, authority: str, settings: dict[str, str]) -> tuple[str, dict, str]:
    """Kind of store, its arguments, and what goes before a path in it."""
    if scheme == "file":
        return "local", {}, ""
    if scheme in ("s3", "s3a", "s3n"):
        bucket = authority.rpartition("@")[2]

        def said(key: str) -> str | None:
            return settings.get(f"fs.s3a.bucket.{bucket}.{key}") or settings.get(f"fs.s3a.{key}")

        out = {arg: v for key, arg in _S3.items() if (v := said(key))}
        if "endpoint_override" in out:
            out["endpoint_override"] = re.sub(r"^https?://", "", out["endpoint_override"])
        if (said("connection.ssl.enabled") or "true").lower() == "false" or (said("endpoint") or "").startswith("http://"):
            out["scheme"] = "http"
        if "Anonymous" in (said("aws.credentials.provider") or ""):
            out["anonymous"] = True
        if (said("path.style.access") or "false").lower() != "true" and "endpoint_override" in out:
            out["force_virtual_addressing"] = True
        return "s3", out, bucket
    if scheme in ("abfs", "abfss", "wasb", "wasbs"):
        container, _, host = authority.partition("@")
        out = {"account_name": host.partition(".")[0]}
        for key, arg in ((f"fs.azure.account.key.{host}", "account_key"), (f"fs.azure.sas.fixed.token.{host}", "sas_token")):
            if settings.get(key):
                out[arg] = settings[key]
        return "azure", out, container
    if scheme in ("gs", "gcs"):
        return "gcs", {}, authority
    if scheme in ("hdfs", "viewfs"):
        host, _, port = (authority or located(settings.get("fs.defaultFS", ""))[1] or "default").partition(":")
        host = f"viewfs://{host}" if scheme == "viewfs" else host
        return "hdfs", {"host": host, "port": int(port or 0)}, ""
    raise ValueError(f"no store is known for {scheme}:")


@lru_cache(maxsize=64)
def _store(kind: str, args: tuple):
    import pyarrow.fs as fs

    made = {"local": "LocalFileSystem", "s3": "S3FileSystem", "azure": "AzureFileSystem", "gcs": "GcsFileSystem", "hdfs": "HadoopFileSystem"}[kind]
    if not hasattr(fs, made):
        raise ValueError(f"this build has no {made}")
    return getattr(fs, made)(**dict(args))


def opened(file: str, settings: dict[str, str], mounts: dict[str, str] | None = None):
    """An open file to read from; its store is made once per task."""
    scheme, authority, path = located(file, mounts)
    kind, args, before = arguments(scheme, authority, settings)
    return _store(kind, tuple(sorted(args.items()))).open_input_file(before + path if before else path)
