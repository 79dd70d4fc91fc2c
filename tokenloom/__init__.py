"""tokenloom: corpus preparation and router analytics as Spark DataFrame operators.

Every public operator is a plain function ``f(df, *, cols...) -> DataFrame``.
Nothing collects to the driver; order-dependent operators take an explicit
order key instead of relying on physical row order.
"""

from tokenloom.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
