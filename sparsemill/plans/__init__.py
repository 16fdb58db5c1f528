"""Model specifications: the transform language and the options that describe a model."""
