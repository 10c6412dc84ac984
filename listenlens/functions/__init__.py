"""Column expressions (JVM-side, codegen-friendly); no Python UDFs."""

from listenlens.functions.columns import *  # noqa: F401,F403
