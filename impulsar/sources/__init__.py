"""Panel input and its checks."""
