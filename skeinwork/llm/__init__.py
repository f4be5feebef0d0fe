"""Training-data operators over ``documents`` and ``conversations``: nothing outside this subpackage imports it."""
