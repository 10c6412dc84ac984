"""listenlens: per-listener music analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames; aggregates take
``keys`` (default ``["user_id"]``; ``[]`` gives one whole-frame answer).
Nothing is collected to the driver except small model metadata.
"""

from listenlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
