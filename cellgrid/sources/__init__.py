"""Reading inputs into the shapes that the operators take."""
