"""Tables in versions: each change is a whole new folder, v0, v1 and so on, of which the last one counts.

A version is written under a hidden name and gets its own by one rename that fails where that name is taken. So a writer
that dies leaves nothing that is read, and of two writers that started from the same version one comes second: it
works its change out again from the version of the first. This asks for a file system whose renames are atomic (as
local ones, HDFS and its like are)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NOTE = "_note"


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, folder: str):  # noqa: ANN202
    return _path(spark, folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    return _files(spark, name).exists(_path(spark, name))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of the table in `folder`, in order."""
    if not exists(spark, folder):
        return []
    names = [x.getPath().getName() for x in _files(spark, folder).listStatus(_path(spark, folder))]
    return sorted(int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit())


def latest(spark: SparkSession, folder: str) -> str | None:
    """The folder of the last version."""
    found = versions(spark, folder)
    return f"{folder}/v{found[-1]}" if found else None


def note_of(spark: SparkSession, version: str) -> str:
    """What was noted with a version."""
    if not exists(spark, f"{version}/{_NOTE}"):
        return ""
    stream = _files(spark, version).open(_path(spark, f"{version}/{_NOTE}"))
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _taken(spark: SparkSession, staging: str, version: str) -> bool:
    """Gives the staged folder its name; false where another writer has it."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, staging).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, staging), _path(spark, version), options)
    except Py4JJavaError:
        if not exists(spark, version):
            raise
        _files(spark, staging).delete(_path(spark, staging), True)
        return False
    return True


def commit(spark: SparkSession, folder: str, change: Callable[[str | None, str], str | None], keep: int = 2, tries: int = 50) -> str:
    """Publishes the next version. `change(last, staging)` writes the folder `staging` from the last version and returns
    a note for it; if it writes nothing, nothing changes. Older versions than the last `keep` go. The version's folder."""
    for _ in range(tries):
        found = versions(spark, folder)
        last = f"{folder}/v{found[-1]}" if found else None
        staging, version = f"{folder}/_staging-{uuid.uuid4().hex}", f"{folder}/v{found[-1] + 1 if found else 0}"
        note = change(last, staging)
        if not exists(spark, staging) and note is None and last:
            return last
        out = _files(spark, folder).create(_path(spark, f"{staging}/{_NOTE}"))
        out.writeUTF(note or "")
        out.close()
        if _taken(spark, staging, version):
            for old in found[: max(0, len(found) + 1 - keep)]:
                _files(spark, folder).delete(_path(spark, f"{folder}/v{old}"), True)
            return version
    raise RuntimeError(f"{folder} changed {tries} times while a change to it was worked out")


def move_files(spark: SparkSession, staging: str, folder: str) -> None:
    """Moves the files of a written table, whose names are unique, into the same sub-folders of another; the table's folder
    goes."""
    files = _files(spark, folder)
    top = files.makeQualified(_path(spark, staging)).toString()
    found = files.listFiles(_path(spark, staging), True)
    made: set[str] = set()
    while found.hasNext():
        source = found.next().getPath()
        if source.getName().startswith(("_", ".")):
            continue
        part = source.getParent().toString().removeprefix(top).strip("/")
        if part not in made:
            files.mkdirs(_path(spark, f"{folder}/{part}" if part else folder))
            made.add(part)
        if not files.rename(source, _path(spark, f"{folder}/{part}/{source.getName()}" if part else f"{folder}/{source.getName()}")):
            raise OSError(f"{source} could not be moved into {folder}")
    files.delete(_path(spark, staging), True)
