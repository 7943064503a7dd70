"""Column functions of intervals, resolutions, quantifiers, reducers and series."""
