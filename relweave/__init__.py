"""relweave: relational feature engineering and scoring on Spark DataFrames."""

from relweave.schema import DatasetConfig, Relation, RelationalDataset
from relweave.session import DEFAULT_SCALE, Scale, build_session, materialize

__all__ = ["DEFAULT_SCALE", "DatasetConfig", "Relation", "RelationalDataset", "Scale", "build_session", "materialize"]
