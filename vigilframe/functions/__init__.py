"""Native column functions (no Python runs per row)."""

from vigilframe.functions.scalars import *  # noqa: F401,F403
from vigilframe.functions.stats import *  # noqa: F401,F403
from vigilframe.functions.masking import mask_tokens, mask_token, split_punct, mask_class  # noqa: F401
from vigilframe.functions.sql import register_sql_functions  # noqa: F401
