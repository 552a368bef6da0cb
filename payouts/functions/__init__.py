"""Column functions: every one takes and returns Spark columns, no UDFs in the hot path."""

from payouts.functions.dates import *  # noqa: F401,F403
from payouts.functions.numbers import *  # noqa: F401,F403
from payouts.functions.status import *  # noqa: F401,F403
from payouts.functions.text import *  # noqa: F401,F403
