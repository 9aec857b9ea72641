"""Where usage events come from and go to."""
