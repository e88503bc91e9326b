"""Column-expression building blocks (all built-in Spark functions)."""

from tabsight.functions.exprs import *  # noqa: F401,F403
from tabsight.functions.text import *  # noqa: F401,F403
