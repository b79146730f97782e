"""Registered queries."""

from . import measured as measured
from . import registry as registry
from . import relational as relational
from . import stored as stored
from . import streams as streams
from . import user_functions as user_functions
from . import values as values
