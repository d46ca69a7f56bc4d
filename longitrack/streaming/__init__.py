"""Nothing in the analysed workflows is a stream: sessions are finished acquisitions.

New sessions are added by running the matcher again on a longer manifest; see
:func:`longitrack.plans.daywise.run_matching` with ``resume``.
"""
