"""Descriptions of backup and restore jobs."""

from dataclasses import dataclass, field

from logkeep import schemas
from logkeep.functions.patterns import TopicSelector
from logkeep.sources.storage import Storage


def _check_layout(layout):
    if layout not in ("archive", "objects"):
        raise ValueError(f"unknown layout: {layout}")


@dataclass(frozen=True)
class BackupJob:
    backup_id: str
    root: str
    selectors: tuple[TopicSelector, ...]
    workers: int = 1
    seed: int = 0
    batch_size: int = 1000
    interval_seconds: float = 30.0
    segmentation: str = "count"  # count, offset or interval
    layout: str = "archive"  # archive (Parquet) or objects (one JSON array per segment)
    compression: bool = True
    storage: Storage | None = None  # settings of the object store below the root
    # Copy the log to the shared folder first. Segmenting scans a log more than once,
    # so a source that grows or expires meanwhile, such as Kafka, must be landed.
    land: bool = False
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.root:
            raise ValueError(schemas.NO_TARGET_STORAGE)
        if not self.selectors:
            raise ValueError(schemas.NO_SELECTOR)
        if self.workers < 1:
            raise ValueError(schemas.NO_WORKER)
        if self.batch_size < 1:
            raise ValueError(schemas.NO_BATCH)
        if self.segmentation not in ("count", "offset", "interval"):
            raise ValueError(f"unknown segmentation: {self.segmentation}")
        _check_layout(self.layout)


@dataclass(frozen=True)
class RestoreJob:
    restore_id: str
    root: str
    backup_id: str | None = None
    backup_timestamp: object = None
    selectors: tuple[TopicSelector, ...] = ()
    mapping: dict = field(default_factory=dict)
    partition_filter: dict = field(default_factory=dict)
    workers: int = 1
    create_topics: bool = True
    # By default messages that the target holds already are not written again.
    overwrite_existing: bool = False
    layout: str = "archive"
    storage: Storage | None = None
    # Replay so many segments of each partition at a time, in order; such a replay can go on
    # where it was broken off. None replays all at once into files.
    segments_per_wave: int | None = None

    def __post_init__(self):
        if not self.root:
            raise ValueError(schemas.NO_SOURCE_STORAGE)
        if not self.backup_id and self.backup_timestamp is None:
            raise ValueError(schemas.NO_BACKUP)
        _check_layout(self.layout)
        if self.workers < 1:
            raise ValueError(schemas.NO_WORKER)
        if self.segments_per_wave is not None and self.segments_per_wave < 1:
            raise ValueError(schemas.NO_BATCH)
