"""Numbered records of a folder, each created only if it is absent.

A record is one small JSON file; its number is its name. Writers read the newest record,
decide, and create the next number. Only one of two writers that decide on the same record
succeeds; the other reads again. The driver touches one small file a record and never lists
data folders. Files appear under their name complete: they are written aside, then linked or
renamed without overwriting. An object store needs conditional creation of objects for that.
"""

import json
import os
import time
import uuid


def _path(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark, path):
    folder = _path(spark, path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def file_name(number):
    return f"{int(number):012d}.json"


def _stage(spark, path, text):
    folder, name = path.rsplit("/", 1)
    system, staged = _system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    system.mkdirs(_path(spark, folder))
    out = system.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    return system, staged


def create_if_absent(spark, path, text):
    """Whether this call made the file ``path``; a file that is there stays as it is."""
    jvm = spark._jvm
    system, staged = _stage(spark, path, text)
    try:
        if system.getUri().getScheme() == "file":
            source, target = (p.toUri().getPath() for p in (staged, _path(spark, path)))
            os.link(source, target)  # fails if the target is there, unlike a local rename
            return True
        options = spark.sparkContext._gateway.new_array(
            getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(staged, _path(spark, path), options)
        return True
    except FileExistsError:
        return False
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    finally:
        system.delete(staged, False)


def replace(spark, path, text):
    """Write the file ``path``, which readers see whole, old or new."""
    system, staged = _stage(spark, path, text)
    if system.getUri().getScheme() == "file":
        os.replace(staged.toUri().getPath(), _path(spark, path).toUri().getPath())
        system.delete(staged, False)
        return
    system.delete(_path(spark, path), False)
    system.rename(staged, _path(spark, path))


def read_text(spark, path):
    system, file = _system(spark, path)
    source = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def children(spark, folder):
    """(name, modified in seconds) of what lies directly in a folder; none if it is missing."""
    system, place = _system(spark, folder)
    if not system.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in system.listStatus(place)]


def newest(spark, folder):
    """(number, record) of the newest record; (-1, None) if there is none."""
    numbers = [int(n[:-5]) for n, _ in children(spark, folder) if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return -1, None
    return max(numbers), json.loads(read_text(spark, f"{folder}/{file_name(max(numbers))}"))


def append(spark, folder, decide):
    """Create the record that ``decide(number, newest record)`` gives; asks again if another came first."""
    while True:
        number, record = newest(spark, folder)
        made = decide(number, record)
        if create_if_absent(spark, f"{folder}/{file_name(number + 1)}", json.dumps(made)):
            return number + 1, made
        time.sleep(0.01)


def delete(spark, path):
    """Delete a file or a folder and all in it."""
    system, place = _system(spark, path)
    system.delete(place, True)
