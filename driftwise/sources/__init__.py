from driftwise.sources.io import *  # noqa: F401,F403
from driftwise.sources.views import *  # noqa: F401,F403
