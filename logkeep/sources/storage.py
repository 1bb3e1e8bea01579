"""Storage locations and object listings."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from logkeep.functions.paths import parse_key


@dataclass(frozen=True)
class Storage:
    type: str  # s3, azure, gcs or local
    path: str  # bucket, container@account or folder
    prefix: str = ""
    region: str | None = None
    endpoint: str | None = None
    path_style: bool = False

    def uri(self):
        """Root URI with the prefix applied once."""
        if self.type == "local":
            base = "file://" + ("" if self.path.startswith("/") else "/") + self.path.rstrip("/")
        elif self.type == "s3":
            base = f"s3a://{self.path.strip('/')}"
        elif self.type == "gcs":
            base = f"gs://{self.path.strip('/')}"
        elif self.type == "azure":
            container, account = self.path.split("@", 1)
            base = f"abfss://{container}@{account}.dfs.core.windows.net"
        else:
            raise ValueError(f"unsupported storage type: {self.type}")
        prefix = self.prefix.strip("/")
        return f"{base}/{prefix}" if prefix else base

    def hadoop_conf(self):
        if self.type != "s3":
            return {}
        found = {}
        if self.endpoint:
            found["fs.s3a.endpoint"] = self.endpoint
        if self.region:
            found["fs.s3a.endpoint.region"] = self.region
        if self.path_style:
            found["fs.s3a.path.style.access"] = "true"
        return found

    def arrow_options(self):
        """Arguments of Arrow's S3 file system for the same place."""
        if self.type != "s3":
            return {}
        found = {"force_virtual_addressing": not self.path_style}
        if self.endpoint:
            scheme, _, host = self.endpoint.rpartition("://")
            found |= {"endpoint_override": host, "scheme": scheme or "https"}
        if self.region:
            found["region"] = self.region
        return found


def use_storage(spark, storage):
    """Let the session's file systems reach a store: endpoint, region, path style."""
    for name, value in (storage.hadoop_conf() if storage else {}).items():
        spark.sparkContext._jsc.hadoopConfiguration().set(name, value)


def list_objects(spark, root, glob="*"):
    """Path, size and modification time of every object; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
        )
    )


def list_segments(spark, root):
    """Segment objects with the parts of their key, parsed exactly."""
    return (
        list_objects(spark, root, "segment-*.json*")
        .withColumn("_key", parse_key(F.col("path")))
        .where(F.col("_key").isNotNull())
        .select(
            "path", "size_bytes", "modified", "_key.*",
            F.regexp_extract("path", r"((?:runs/[^/]+/[^/]+/)?backups/[^/]+/topics/.*)$", 1).alias("storage_key"),
        )
    )
