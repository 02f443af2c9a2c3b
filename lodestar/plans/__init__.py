from .position import with_position
from .skew import in_keys, join_sized
from .splits import fixed_splits
from .stage import BatchStage, empty, fresh_dir, spread, stage

__all__ = ["BatchStage", "empty", "fixed_splits", "fresh_dir", "in_keys", "join_sized", "spread", "stage", "with_position"]
