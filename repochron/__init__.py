"""repochron: repository-history analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazy DataFrame; nothing is collected to the driver.
"""

from repochron.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
