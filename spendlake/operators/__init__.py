"""DataFrame-in, DataFrame-out operators.

Lazy, except those that need a global order or a counted side: they settle it first, and
say so.
"""
